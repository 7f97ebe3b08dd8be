"""The engine's queries over the driver's tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import struct
import zlib
from functools import partial, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules as R
from ..operators import classify as K
from ..operators import detect as D
from ..operators import provenance as P
from ..operators import raster
from ..operators import redact as X
from ..session import settle
from ..sources import image as IMG
from ..sources import pdf as PDF
from ..sources import text as T
from ..streaming import streams
from . import pipeline, planted
from .policies import POLICIES, PRIVACY, US_CAPCO

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- single rules in the JVM

EMAIL = R.CONTACT[0].pattern
QUAD = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
CARD = r"(?<![\d-])(?:\d[ -]?){11,18}\d(?![\d-])"
PHONE = r"(?<![\w+])\+?\d[\d\s().-]{5,18}\d(?!\w)"
SECRET = r"""(?i)(?:api[_ -]?key|secret|token)["']?[ \t]{0,4}[:=][ \t]{0,4}["']?([A-Za-z0-9+/_.=-]{16,})"""

_Q_EMAIL = EMAIL.replace("'", "''")
_Q_QUAD = r"(?:^|[^0-9.])((?:[0-9]{1,3}\.){3}[0-9]{1,3})(?:$|[^0-9.]|\.[^0-9]|\.$)"
_Q_CARD = r"(?:^|[^0-9-])((?:[0-9](?:  |-)?){11,18}[0-9])(?:$|[^0-9-])"  # over texts whose other characters are doubled, so that neighbours share none
_Q_PHONE = r"(?:^|[^A-Za-z0-9_+])(\+?[0-9][0-9\s().-]{5,18}[0-9])(?:$|[^A-Za-z0-9_])"
_Q_SECRET = SECRET.replace("'", "''")


def _hits(docs: DataFrame, pattern: str, group: int = 0, guard: str | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, start, end, value``; the guard spares texts without the cheap part of the shape."""
    some = docs.where(F.col("text").rlike(guard or pattern))
    return some.select(*keys, F.explode(C.spans(F.col("text"), pattern, group)).alias("s")).select(*keys, "s.*")


def _email_ok(v):
    local, domain = F.regexp_extract(v, "^(.*)@([^@]*)$", 1), F.regexp_extract(v, "^(.*)@([^@]*)$", 2)
    return ~local.rlike(r"^\.|\.$|\.\.") & ~domain.rlike(r"^-|\.\.|^\.") & ~domain.rlike(r"[^.]{64}")


def _card_ok(v):
    digits = C.strip_separators(v)
    return F.length(digits).between(13, 19) & C.luhn(v) & C.card_brand(digits).isNotNull()


_BRANDS = r"^4\d{12}(\d{3})?(\d{3})?$|^(5[1-5]\d{14}|2(22[1-9]|2[3-9]\d|[3-6]\d{2}|7[01]\d|720)\d{12})$|^3[47]\d{13}$|^3(0[0-5]|[68]\d)\d{11}$|^6(011|5\d{2}|4[4-9]\d)\d{12}$|^(2131|1800|35\d{3})\d{11}$|^62\d{14,17}$"
_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN {d}[i]::INT ELSE CASE WHEN {d}[i]::INT > 4 THEN {d}[i]::INT * 2 - 9 ELSE {d}[i]::INT * 2 END END)) % 10 = 0"
_WITH = rf"""
WITH texts AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
emails AS (
  SELECT doc_id, v AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_Q_EMAIL}')) AS v FROM texts)
  WHERE NOT regexp_matches(regexp_extract(v, '^(.*)@', 1), '^\.|\.$|\.\.') AND NOT regexp_matches(regexp_extract(v, '@([^@]*)$', 1), '^-|\.\.|^\.')),
quads AS (
  SELECT doc_id, v AS value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_Q_QUAD}', 1)) AS v FROM texts)
  WHERE regexp_matches(v, '^((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(\.|$)){{4}}$') AND NOT regexp_matches(v, '^(0|127|255)\.|^192\.0\.|^198\.(51|18|19)\.|^203\.0\.')),
cards AS (
  SELECT doc_id, v AS value, d FROM (SELECT doc_id, v, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM (
    SELECT doc_id, replace(unnest(regexp_extract_all(regexp_replace(text, '([^0-9-])', '\1\1', 'g'), '{_Q_CARD}', 1)), '  ', ' ') AS v FROM texts))
  WHERE length(d) BETWEEN 13 AND 19 AND regexp_matches(d, '{_BRANDS}') AND {_LUHN.format(d="d")}),
phones AS (
  SELECT doc_id, v AS value, d FROM (SELECT doc_id, v, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_Q_PHONE}', 1)) AS v FROM texts))
  WHERE length(d) BETWEEN 7 AND 15 AND NOT regexp_matches(v, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$') AND NOT regexp_matches(v, '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$')
    AND NOT regexp_matches(d, '^1?555(01[0-9]{{2}}|555[0-9]{{4}})$') AND len(list_distinct(string_split(d, ''))) > 1),
secrets AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_Q_SECRET}', 1)) AS value FROM texts)
"""


def _emails(docs):
    return _hits(docs, EMAIL, guard="@").where(_email_ok(F.col("value")))


def _quads(docs):
    return _hits(docs, QUAD, guard=r"\d\.\d").where(C.ipv4(F.col("value")) & ~C.reserved_ipv4(F.col("value")))


def _cards(docs):
    return _hits(docs, CARD, guard=r"\d(?:[ -]?\d){12}").where(_card_ok(F.col("value")))


def _phones(docs):
    v, d = F.col("value"), F.regexp_replace("value", r"\D", "")
    fine = F.length(d).between(7, 15) & ~v.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & ~v.rlike(r"^\d{3}-\d{2}-\d{4}$") & ~d.rlike(r"^1?555(01\d{2}|555\d{4})$") & ~d.rlike(r"^(.)\1+$")
    return _hits(docs, PHONE, guard=r"\d").where(fine)


def _secrets(docs):
    return _hits(docs, SECRET, 1, guard="(?i)key|secret|token")


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _counted(rows: DataFrame, confidence: float) -> DataFrame:
    return rows.groupBy("doc_id", "value").agg(F.count("*").alias("n"), F.max(F.lit(confidence)).alias("confidence"))


def _counted_sql(name: str, confidence: float) -> str:
    return f"{_WITH} SELECT doc_id, value, count(*) AS n, {confidence}::DOUBLE AS confidence FROM {name} GROUP BY doc_id, value"


@query(_counted_sql("emails", 0.95))
def detect_email(spark, sf_dir):
    return _counted(_emails(_docs(spark, sf_dir)), 0.95)


@query(_counted_sql("quads", 0.99))
def detect_ipv4(spark, sf_dir):
    return _counted(_quads(_docs(spark, sf_dir)), 0.99)


@query(_counted_sql("cards", 0.99))
def detect_card(spark, sf_dir):
    return _counted(_cards(_docs(spark, sf_dir)), 0.99)


@query(_counted_sql("phones", 0.65))
def detect_phone(spark, sf_dir):
    return _counted(_phones(_docs(spark, sf_dir)), 0.65)


@query(f"""{_WITH}, bits AS (
  SELECT doc_id, value, len(value) AS size, unnest(list_distinct(string_split(value, ''))) AS c FROM secrets)
SELECT doc_id, value, round(-sum((size - length(replace(value, c, ''))) / size * log2((size - length(replace(value, c, ''))) / size)), 6) AS bits
FROM (SELECT DISTINCT * FROM bits) GROUP BY doc_id, value""")
def detect_secret(spark, sf_dir):
    return _secrets(_docs(spark, sf_dir)).select("doc_id", "value").distinct().withColumn("bits", F.round(C.entropy(F.col("value")), 6))


TERMS = ["MIT License", "Apache License", "GNU General Public License", "CC BY-NC 4.0"]


@query(r"""
SELECT CAST(doc_id AS VARCHAR) AS doc_id, value, count(*) AS n FROM (
  SELECT doc_id, lower(unnest(regexp_extract_all(text, '(?i)(?:^|[^\p{L}\p{N}_])(GNU General Public License|Apache License|CC BY-NC 4\.0|MIT License)(?:$|[^\p{L}\p{N}_])', 1))) AS value FROM documents)
GROUP BY doc_id, value""")
def detect_terms(spark, sf_dir):
    found = D.terms(T.paragraphs(_docs(spark, sf_dir)), TERMS)
    return found.groupBy("doc_id", F.col("normalized").alias("value")).agg(F.count("*").alias("n"))


@query(rf"""
WITH stripped AS (
  SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(?:script|style)\b.*?</(?:script|style)\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
texts AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') AS text FROM stripped)
SELECT page_id, v AS value, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(text, '{_Q_EMAIL}')) AS v FROM texts)
WHERE NOT regexp_matches(regexp_extract(v, '^(.*)@', 1), '^\.|\.$|\.\.') AND NOT regexp_matches(regexp_extract(v, '@([^@]*)$', 1), '^-|\.\.|^\.') GROUP BY page_id, v""")
def detect_pages(spark, sf_dir):
    texts = _table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))
    return _hits(texts, EMAIL, guard="@", keys=("page_id",)).where(_email_ok(F.col("value"))).groupBy("page_id", "value").agg(F.count("*").alias("n"))


@query(f"""{_WITH}
SELECT type, count(*) AS n FROM (
  SELECT 'contact.email' AS type FROM emails UNION ALL SELECT 'net.ipv4' FROM quads UNION ALL SELECT 'financial.card' FROM cards UNION ALL SELECT 'secret.api-key' FROM secrets) GROUP BY type""")
def counts_by_type(spark, sf_dir):
    """The Arrow scan over four rules, resolved and counted."""
    return D.counts_by_type(_resolved(spark, sf_dir))


FOUR = ("contact.email", "net.ipv4", "financial.card", "secret.labelled")


def _resolved(spark, sf_dir, rules=FOUR) -> DataFrame:
    return D.resolve_overlaps(D.patterns(T.paragraphs(_docs(spark, sf_dir)), R.select(R.ALL, include=rules)))


@query(f"""{_WITH}, every AS (
  SELECT doc_id, 'contact.email' AS type FROM emails UNION ALL SELECT doc_id, 'net.ipv4' FROM quads UNION ALL SELECT doc_id, 'financial.card' FROM cards UNION ALL SELECT doc_id, 'secret.api-key' FROM secrets)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS n_findings,
  CASE WHEN bool_or(type = 'secret.api-key') THEN 'restricted' WHEN bool_or(type IN ('contact.email', 'financial.card')) THEN 'personal' ELSE 'open' END AS level,
  '[' || CASE WHEN bool_or(type = 'secret.api-key') THEN 'R' WHEN bool_or(type IN ('contact.email', 'financial.card')) THEN 'PD' ELSE 'O' END
  || CASE WHEN bool_or(type = 'financial.card') THEN ' // A4/CHD' WHEN bool_or(type = 'contact.email') THEN ' // A4' ELSE '' END
  || CASE WHEN bool_or(type IN ('secret.api-key', 'financial.card')) THEN ' // NP' WHEN bool_or(type = 'contact.email') THEN ' // PSEUDO' ELSE '' END || ']' AS marking
FROM every GROUP BY doc_id""")
def classify_portions(spark, sf_dir):
    nodes = T.paragraphs(_docs(spark, sf_dir))
    sure = K.eligible(_resolved(spark, sf_dir), nodes)
    return K.classify_portions(PRIVACY, sure).select("doc_id", "n_findings", "level", "marking")


@query(f"""{_WITH}, every AS (
  SELECT doc_id, 'contact.email' AS type FROM emails UNION ALL SELECT doc_id, 'net.ipv4' FROM quads UNION ALL SELECT doc_id, 'financial.card' FROM cards UNION ALL SELECT doc_id, 'secret.api-key' FROM secrets),
flags AS (SELECT d.doc_id, coalesce(bool_or(type IN ('contact.email', 'financial.card')), false) AS privacy, coalesce(bool_or(type IN ('net.ipv4', 'secret.api-key')), false) AS opsec
  FROM documents d LEFT JOIN every e ON d.doc_id = e.doc_id GROUP BY d.doc_id)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN privacy OR opsec THEN 'cui' ELSE 'unclassified' END AS level,
  CASE WHEN privacy AND opsec THEN 'CUI//SP-PRVCY/SP-OPSEC' WHEN privacy THEN 'CUI//SP-PRVCY' WHEN opsec THEN 'CUI//SP-OPSEC' ELSE 'UNCLASSIFIED' END AS banner
FROM flags""")
def classify_banner(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    nodes = T.paragraphs(docs)
    sure = settle(K.eligible(_resolved(spark, sf_dir), nodes))
    return K.classify_documents(US_CAPCO, docs, sure, K.classify_portions(US_CAPCO, sure)).select("doc_id", "level", "banner")


@query(f"""{_WITH}, every AS (
  SELECT doc_id, 'contact.email' AS type FROM emails UNION ALL SELECT doc_id, 'net.ipv4' FROM quads UNION ALL SELECT doc_id, 'financial.card' FROM cards UNION ALL SELECT doc_id, 'secret.api-key' FROM secrets)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(DISTINCT type) AS kinds FROM every GROUP BY doc_id HAVING count(DISTINCT type) >= 2""")
def mosaic_documents(spark, sf_dir):
    """Documents in which kinds of identifiers co-occur."""
    return _resolved(spark, sf_dir).groupBy("doc_id").agg(F.count_distinct("type").alias("kinds")).where("kinds >= 2")


# ---- redaction


def _two(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    nodes = T.paragraphs(docs)
    sure = settle(K.eligible(_resolved(spark, sf_dir, ("contact.email", "secret.labelled")), nodes))
    ops, retained = X.plan(nodes, sure, K.classify_portions(PRIVACY, sure))
    return nodes, sure, settle(ops), retained


_REDACTED = f"regexp_replace(regexp_replace(text, '{_Q_EMAIL}', '[REDACTED]', 'g'), '(?i)((?:api[_ -]?key|secret|token)[\"'']?[ \\t]{{0,4}}[:=][ \\t]{{0,4}}[\"'']?)[A-Za-z0-9+/_.=-]{{16,}}', '\\1[REDACTED]', 'g')"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, sha256({_REDACTED}) AS digest FROM documents WHERE trim(text) <> ''")
def redact_text(spark, sf_dir):
    nodes, _, ops, _ = _two(spark, sf_dir)
    return T.join_paragraphs(X.apply(nodes, ops)).select("doc_id", F.sha2("text", 256).alias("digest"))


_OPS = f"{_WITH}, every AS (SELECT doc_id, 'e' AS k FROM emails UNION ALL SELECT doc_id, 's' FROM secrets)"


@query(f"{_OPS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS operations, 0::BIGINT AS leaks, true AS passed FROM every GROUP BY doc_id")
def verify_clean(spark, sf_dir):
    nodes, _, ops, retained = _two(spark, sf_dir)
    return X.verify(ops, retained, X.apply(nodes, ops))["report"].select("doc_id", "operations", "leaks", "passed")


@query(f"{_OPS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) FILTER (WHERE k = 'e') AS leaks, bool_and(k = 's') AS passed FROM every GROUP BY doc_id")
def verify_leaky(spark, sf_dir):
    """An applier that forgets the e-mail operations is caught, one leak each."""
    nodes, _, ops, retained = _two(spark, sf_dir)
    lazy = ops.where(~F.contains("original", F.lit("@")))
    return X.verify(ops, retained, X.apply(nodes, lazy))["report"].select("doc_id", "leaks", "passed")


_ENTRY = """'{"authority":"Policy determination","entity_types":["' || type || '"],"location":"' || location || '","operation_id":"' || op_id || '","previous":"' || PREVIOUS || '","reason_code":"policy.sensitive-content","seq":' || SEQ || ',"strategy":"replace","value_digest":"' || digest || '","value_length":' || size || '}'"""


@query(f"""WITH RECURSIVE ops AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, s_suppkey AS k, unnest(range(0, 3)) AS i FROM supplier),
listed AS (
  SELECT doc_id, 'p0:t:' || (i * 10) || '-' || (i * 10 + 5) AS location, 'op_' || k || '_' || i AS op_id, CASE i WHEN 1 THEN 'gov.ssn' ELSE 'contact.email' END AS type,
         sha256('a fixed salt of the query' || 'v' || k || '-' || i) AS digest, length('v' || k || '-' || i) AS size FROM ops),
entries AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY location) - 1 AS seq FROM listed),
chain AS (
  SELECT doc_id, seq, sha256({_ENTRY.replace("PREVIOUS", "repeat('0', 64)").replace("SEQ", "seq")}) AS hash FROM entries WHERE seq = 0
  UNION ALL SELECT e.doc_id, e.seq, sha256({_ENTRY.replace("PREVIOUS", "c.hash").replace("SEQ", "e.seq")}) FROM chain c JOIN entries e ON e.doc_id = c.doc_id AND e.seq = c.seq + 1)
SELECT doc_id, CAST(seq AS INTEGER) AS seq, hash FROM chain""")
def manifest_hashes(spark, sf_dir):
    """The hash chain itself, over three operations a supplier."""
    salt, one = b"a fixed salt of the query", F.explode(F.sequence(F.lit(0), F.lit(2)))
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), one.alias("i"))
    ops = rows.select(
        "doc_id", F.concat(F.lit("op_"), "doc_id", F.lit("_"), "i").alias("op_id"), F.lit("replace").alias("strategy"), F.concat(F.lit("p0:t:"), F.col("i") * 10, F.lit("-"), F.col("i") * 10 + 5).alias("location"),
        F.lit("policy.sensitive-content").alias("reason_code"), F.lit("Policy determination").alias("authority"), F.concat(F.lit("v"), "doc_id", F.lit("-"), "i").alias("original"), F.array(F.concat(F.lit("f"), "i")).alias("finding_ids"),
    )
    found = rows.select("doc_id", F.concat(F.lit("f"), "i").alias("id"), F.when(F.col("i") == 1, "gov.ssn").otherwise("contact.email").alias("type"))
    return P.manifest_entries(ops, found, salt).select("doc_id", "seq", "hash")


@query(f"{_OPS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS entries, true AS intact FROM every GROUP BY doc_id")
def manifest_chain(spark, sf_dir):
    _, sure, ops, _ = _two(spark, sf_dir)
    entries = settle(P.manifest_entries(ops, sure, b"a fixed salt of the query"))
    return entries.groupBy("doc_id").agg(F.count("*").alias("entries")).join(P.verify_chain(entries).select("doc_id", "intact"), "doc_id")


@query(f"{_OPS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, 0 AS first_break FROM every GROUP BY doc_id")
def manifest_tamper(spark, sf_dir):
    """A changed authority in each first entry breaks its chain there."""
    _, sure, ops, _ = _two(spark, sf_dir)
    entries = P.manifest_entries(ops, sure, b"a fixed salt of the query")
    forged = entries.withColumn("authority", F.when(F.col("seq") == 0, "another").otherwise(F.col("authority")))
    return P.verify_chain(forged).select("doc_id", F.col("first_break").cast("int").alias("first_break"))


@query(f"{_WITH} SELECT lower(value) AS value, count(DISTINCT doc_id) AS n_docs, 1::BIGINT AS tokens FROM emails GROUP BY lower(value) HAVING count(DISTINCT doc_id) > 1")
def pseudonym_links(spark, sf_dir):
    """One value, one token, in all its documents."""
    token = X.pseudonyms(b"a key of the query only")(F.lit("contact.email"), F.col("value"), F.lower("value"))
    tokens = _emails(_docs(spark, sf_dir)).select("doc_id", F.lower("value").alias("value"), token.alias("token"))
    return tokens.groupBy("value").agg(F.count_distinct("doc_id").alias("n_docs"), F.count_distinct("token").alias("tokens")).where("n_docs > 1")


@query(f"""{_WITH}
SELECT doc_id, list_aggregate(list_transform(range(1, length(value) + 1), lambda i: CASE WHEN regexp_matches(value[i], '[A-Za-z0-9]') AND length(regexp_replace(value[i+1:], '[^A-Za-z0-9]', '', 'g')) >= 4 THEN '*' ELSE value[i] END), 'string_agg', '') AS masked
FROM cards""")
def mask_values(spark, sf_dir):
    return _cards(_docs(spark, sf_dir)).select("doc_id", C.mask_value(F.col("value"), 4).alias("masked"))


@query("""
SELECT c_custkey, 'user' || string_agg(CAST(('0x' || substr(h, 2 * i + 1, 2))::INT % 10 AS VARCHAR), '' ORDER BY i) || '@example.invalid' AS made
FROM (SELECT c_custkey, sha256('f_' || c_custkey) AS h, unnest(range(0, 4)) AS i FROM customer) GROUP BY c_custkey""")
def synthesize_values(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("f_"), F.col("c_custkey").cast("string")).alias("id"), F.lit("contact.email").alias("type"))
    return rows.select("c_custkey", X.synthesize().alias("made"))


# ---- spans


def _spans(spark, sf_dir) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    start = F.pmod(F.col("l_partkey"), F.lit(60)).cast("int")
    return li.select(
        F.col("l_orderkey").cast("string").alias("doc_id"), F.lit("p0").alias("node_id"), F.concat_ws("-", F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), "l_suppkey", "l_partkey", F.col("l_quantity").cast("int")).alias("id"),
        F.lit("r").alias("rule_id"), F.lit("t").alias("type"), F.lit("text").alias("loc_kind"), start.alias("start"), (start + 1 + F.pmod(F.col("l_quantity").cast("int"), F.lit(17))).cast("int").alias("end"),
        F.col("l_discount").alias("confidence"), F.array().cast(D.EVIDENCE).alias("evidence"),
    )


_SPAN_SQL = """
WITH spans AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || '-' || l_suppkey || '-' || l_partkey || '-' || CAST(l_quantity AS INT) AS id, CAST(l_partkey % 60 AS INT) AS s,
         CAST(l_partkey % 60 + 1 + CAST(l_quantity AS INT) % 17 AS INT) AS e, l_discount AS c FROM lineitem)"""


@query(_SPAN_SQL + """,
gone AS (
  SELECT DISTINCT a.doc_id, a.id FROM spans a JOIN spans b ON a.doc_id = b.doc_id AND a.id <> b.id AND b.s <= a.s AND b.e >= a.e
  AND (b.e - b.s > a.e - a.s OR (b.c > a.c OR (b.c = a.c AND b.id < a.id)))),
kept AS (SELECT * FROM spans ANTI JOIN gone USING (doc_id, id)),
owner AS (
  SELECT g.doc_id, g.id, g.c, (SELECT k.id FROM kept k WHERE k.doc_id = g.doc_id AND k.s <= g.s AND k.e >= g.e ORDER BY k.e - k.s DESC, k.c DESC, k.id LIMIT 1) AS box
  FROM spans g SEMI JOIN gone USING (doc_id, id))
SELECT k.doc_id, k.id, k.s AS start, k.e AS "end", greatest(k.c, coalesce(max(o.c), k.c)) AS confidence FROM kept k LEFT JOIN owner o ON o.doc_id = k.doc_id AND o.box = k.id GROUP BY k.doc_id, k.id, k.s, k.e, k.c""")
def resolve_overlaps(spark, sf_dir):
    return D.resolve_overlaps(_spans(spark, sf_dir)).select("doc_id", "id", "start", "end", "confidence")


_MERGE_SQL = _SPAN_SQL + """,
marked AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
islands AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
merged AS (SELECT doc_id, min(s) AS start, max(e) AS "end", count(*) AS members FROM islands GROUP BY doc_id, island)"""


@query(_MERGE_SQL + ' SELECT doc_id, start, "end", members FROM merged')
def merge_spans(spark, sf_dir):
    return X.merge_intervals(_spans(spark, sf_dir), ["doc_id"])


@query(_MERGE_SQL + """,
gaps AS (SELECT doc_id, coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY start), 0) AS a, start AS b FROM merged UNION ALL SELECT doc_id, max("end"), 80 FROM merged GROUP BY doc_id)
SELECT doc_id, a AS start, b AS "end" FROM gaps WHERE a < b""")
def complement_spans(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    return X.complement(X.merge_intervals(spans, ["doc_id"]), ["doc_id"], spans.select("doc_id", F.lit(80).alias("length")).distinct())


@query(f"""
WITH first AS (SELECT doc_id, text, regexp_extract(text, '{_Q_EMAIL}') AS v FROM documents WHERE contains(text, '@')),
spot AS (SELECT doc_id, text, v, instr(text, v) - 1 AS s, instr(text, v) - 1 + length(v) AS e FROM first WHERE v <> ''),
hay AS (SELECT doc_id, v, s, regexp_replace(lower(substr(text, greatest(s - 48, 0) + 1, s - greatest(s - 48, 0)) || ' ' || substr(text, e + 1, 48)), '[_-]+', ' ', 'g') AS h FROM spot)
SELECT doc_id, v AS value, s AS start, h AS haystack,
  (CASE WHEN regexp_matches(h, '(^|[^a-z0-9])the($|[^a-z0-9])') AND (instr(h, 'the') = 1 OR NOT regexp_matches(h[instr(h, 'the') - 1], '[a-z0-9]')) AND NOT regexp_matches(substr(h, instr(h, 'the') + 3, 1), '[a-z0-9]') THEN 0.12 ELSE 0 END)::DOUBLE AS delta
FROM hay""")
def context_windows(spark, sf_dir):
    """The window around each document's first e-mail address, and the gain of one cue."""
    hits = _hits(_docs(spark, sf_dir), EMAIL, guard="@").groupBy("doc_id").agg(F.min_by(F.struct("start", "end", "value"), "start").alias("s"))
    met = _docs(spark, sf_dir).join(hits, "doc_id").withColumn("haystack", C.window_around(F.col("text"), F.col("s.start"), F.col("s.end")))
    return met.select("doc_id", "s.value", F.col("s.start").cast("long").alias("start"), "haystack", C.context_delta(F.col("haystack"), ("the",)).cast("double").alias("delta"))


# ---- validators over key columns

_D9 = "lpad(CAST(l_orderkey * 7919 % 1000000000 AS VARCHAR), 9, '0')"


@query(f"""
WITH k AS (SELECT DISTINCT {_D9} AS d9, lpad(CAST(l_orderkey * 104729 % 10000000000 AS VARCHAR), 10, '0') AS d10 FROM lineitem)
SELECT d9, d10, {_LUHN.format(d="d9")} AS luhn,
  list_sum(list_transform(range(1, 10), lambda i: d9[i]::INT * [3, 7, 1, 3, 7, 1, 3, 7, 1][i])) % 10 = 0 AS aba,
  (11 - list_sum(list_transform(range(1, 10), lambda i: d10[i]::INT * (11 - i))) % 11) % 11 = d10[10]::INT AS nhs,
  NOT (d9[1:3] IN ('000', '666') OR d9[1] = '9' OR d9[4:5] = '00' OR d9[6:9] = '0000' OR d9 IN ('078051120', '219099999')) AS ssn
FROM k""")
def checksum_validators(spark, sf_dir):
    key = _table(spark, sf_dir, "lineitem").select("l_orderkey")
    d9 = F.lpad((F.col("l_orderkey") * 7919 % 1000000000).cast("string"), 9, "0")
    d10 = F.lpad((F.col("l_orderkey") * 104729 % 10000000000).cast("string"), 10, "0")
    rows = key.select(d9.alias("d9"), d10.alias("d10")).distinct()
    return rows.select("d9", "d10", C.luhn(F.col("d9")).alias("luhn"), C.aba_routing(F.col("d9")).alias("aba"), C.nhs_number(F.col("d10")).alias("nhs"), C.us_ssn(F.col("d9")).alias("ssn"))


# ---- reports


@query("""
SELECT lang, source, quality, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, count(*) FILTER (WHERE toxic = 1) AS toxic
FROM documents JOIN labels USING (doc_id) GROUP BY CUBE (lang, source, quality)""")
def risk_report(spark, sf_dir):
    met = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(_table(spark, sf_dir, "labels"), "doc_id")
    return met.cube("lang", "source", "quality").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("SELECT CAST(conv_id AS VARCHAR) AS doc_id, count(*) AS nodes, max(length(text)) AS longest FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def conversation_nodes(spark, sf_dir):
    nodes = T.turns(_table(spark, sf_dir, "conversations")).where("text is not null")
    return nodes.groupBy("doc_id").agg(F.count("*").alias("nodes"), F.max(F.length("text")).cast("long").alias("longest"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    """Tumbling counts as a stream: file source, watermark, windowed state."""
    counted = streams.drain(streams.event_counts(streams.read_stream(spark, f"{sf_dir}/events.parquet")), "complete")
    return counted.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""
WITH marked AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS start FROM numbered GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    found = streams.sessions(_table(spark, sf_dir, "events").select("ts", "user_id"))
    return found.select("user_id", "n", F.unix_micros("start").alias("start"))


# ---- all rules and stages


for _pack in planted.PLANTED:
    QUERIES[f"rules_{_pack}"] = partial(planted.found, pack=_pack)
    SQL[f"rules_{_pack}"] = planted.sql(_pack)
QUERIES["repeat_values"], SQL["repeat_values"] = planted.repeats, planted.REPEATS_SQL


@query()
def detect_all_rules(spark, sf_dir):
    """All rules and all stages over documents."""
    _, found = D.detect(T.paragraphs(_docs(spark, sf_dir)), R.select(R.ALL))
    return found.select("doc_id", "node_id", "rule_id", "type", "start", "end", "value", "normalized", F.round("confidence", 4).alias("confidence"))


_FLAGS = f"""{_WITH}, every AS (
  SELECT doc_id, 'e' AS t FROM emails UNION ALL SELECT doc_id, 'i' FROM quads UNION ALL SELECT doc_id, 'c' FROM cards UNION ALL SELECT doc_id, 's' FROM secrets),
flags AS (SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, coalesce(bool_or(t = 'e'), false) AS e, coalesce(bool_or(t = 'i'), false) AS i, coalesce(bool_or(t = 'c'), false) AS c, coalesce(bool_or(t = 's'), false) AS s
  FROM documents d LEFT JOIN every v ON d.doc_id = v.doc_id GROUP BY d.doc_id)"""


@query(f"""{_FLAGS}
SELECT 'privacy' AS policy, doc_id, CASE WHEN s THEN 'RESTRICTED' WHEN e OR c THEN 'PERSONAL DATA' ELSE 'OPEN' END
  || CASE WHEN c THEN ' // GDPR-ART4/PCI-CHD' WHEN e THEN ' // GDPR-ART4' ELSE '' END || CASE WHEN s OR c THEN ' // DO NOT PUBLISH' WHEN e THEN ' // PSEUDONYMIZED' ELSE '' END AS banner FROM flags
UNION ALL SELECT 'corporate', doc_id, CASE WHEN s THEN 'RESTRICTED' WHEN e OR c THEN 'CONFIDENTIAL' WHEN i THEN 'INTERNAL' ELSE 'PUBLIC' END
  || CASE WHEN (e OR c) AND (c OR s OR i) THEN ' // PERSONAL DATA/NO EXTERNAL DISTRIBUTION' WHEN e OR c THEN ' // PERSONAL DATA' WHEN s OR i THEN ' // NO EXTERNAL DISTRIBUTION' ELSE '' END FROM flags
UNION ALL SELECT 'us-capco', doc_id, CASE WHEN (e OR c) AND (s OR i) THEN 'CUI//SP-PRVCY/SP-OPSEC' WHEN e OR c THEN 'CUI//SP-PRVCY' WHEN s OR i THEN 'CUI//SP-OPSEC' ELSE 'UNCLASSIFIED' END FROM flags
UNION ALL SELECT 'uk-gscp', doc_id, CASE WHEN e OR c OR s THEN 'OFFICIAL-SENSITIVE' ELSE 'OFFICIAL' END || CASE WHEN e AND c THEN ' [COMMERCIAL, PERSONAL]' WHEN c THEN ' [COMMERCIAL]' WHEN e THEN ' [PERSONAL]' ELSE '' END FROM flags
UNION ALL SELECT 'nato', doc_id, CASE WHEN s THEN 'NATO CONFIDENTIAL//NATO EYES ONLY' WHEN e THEN 'NATO RESTRICTED' ELSE 'NATO UNCLASSIFIED' END FROM flags""")
def policy_banners(spark, sf_dir):
    """Each document under each policy."""
    docs = _docs(spark, sf_dir)
    sure = settle(K.eligible(_resolved(spark, sf_dir), T.paragraphs(docs)))
    banners = [K.classify_documents(p, docs, sure, K.classify_portions(p, sure)).select(F.lit(p.id).alias("policy"), "doc_id", "banner") for p in POLICIES.values()]
    return reduce(DataFrame.union, banners)


# ---- files made from the supplier table


def _files(spark, sf_dir, make, deal: bool = False) -> DataFrame:
    """``(doc_id, content)`` of ``make(key, name)`` for every supplier; ``deal`` deals the keys to all cores, where the files hold far more than the table."""

    def run(batches):
        for batch in batches:
            keys, names = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(str, keys), pa.string()), pa.array([make(k, n) for k, n in zip(keys, names)], pa.binary())], names=["doc_id", "content"])

    keys = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    if deal:
        keys = keys.repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey")
    return keys.mapInArrow(run, "doc_id string, content binary")


def _pdf(key: int, name: str) -> bytes:
    paint = f"BT /F1 12 Tf 72 700 Td ({name}) Tj ET BT /F1 12 Tf 72 500 Td (key {key}) Tj ET q 0 g 70 695 220 16 re f Q".encode()
    n, r = PDF.Name, PDF.Ref
    objects = {1: {"Type": n("Catalog"), "Pages": r(2)}, 2: {"Type": n("Pages"), "Kids": [r(3)], "Count": 1}, 3: {"Type": n("Page"), "Parent": r(2), "MediaBox": [0, 0, 612, 792], "Contents": r(4)}, 4: PDF.Stream({}, paint), 5: {"Author": name.encode()}}
    return PDF.assemble(objects, {"Root": r(1), "Info": r(5)})


_KEYS = "WITH keys AS (SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, s_suppkey AS k, s_name AS name FROM supplier)"


@query(f"{_KEYS} SELECT doc_id, 'p0s0t0' AS node_id, name AS text, 'p0s0r0' AS shape_id FROM keys")
def structural_overlay(spark, sf_dir):
    """A shape over live text, by the spatial join; the text beside it is left alone."""
    return D.opaque_over_text(PDF.parse(_files(spark, sf_dir, _pdf))).select("doc_id", "node_id", "text", "shape_id")


@query(f"""{_KEYS} SELECT doc_id, 'info:Author' AS node_id, 'metadata' AS kind, name AS text FROM keys
UNION ALL SELECT doc_id, 'p0s0t0', 'text', name FROM keys UNION ALL SELECT doc_id, 'p0s0t1', 'text', 'key ' || k FROM keys UNION ALL SELECT doc_id, 'p0s0r0', 'vector', NULL FROM keys""")
def pdf_nodes(spark, sf_dir):
    return PDF.parse(_files(spark, sf_dir, _pdf)).where("kind <> 'container'").select("doc_id", "node_id", "kind", "text")


@query(f"{_KEYS} SELECT doc_id, 'key ' || k AS text FROM keys")
def pdf_redacted(spark, sf_dir):
    """The covered text and the author are removed; what is left, read again."""
    files = _files(spark, sf_dir, _pdf)
    targets = F.array(*[F.struct(F.lit(kind).alias("loc_kind"), F.lit(node).alias("node_id")) for kind, node in (("text", "p0s0t0"), ("node", "info:Author"))])
    none = F.lit(None)
    ops = files.select("doc_id", F.explode(targets).alias("t")).select("doc_id", "t.*", F.lit("remove").alias("strategy"), none.cast("string").alias("replacement"), none.cast(T.BBOX).alias("rect"), none.cast("int").alias("page"))
    return PDF.parse(PDF.apply(files, ops).select("doc_id", "content")).where("trim(text) <> ''").select("doc_id", "text")


def _scan(key: int, name: str) -> bytes:
    if key % 5 == 4:
        return b"no file"
    return PDF.image_pdf([{"width": 1 + key % 7, "height": 2, "rgb": bytes(6 * (1 + key % 7))}, {"width": 2, "height": 2, "jpeg": b"\xff\xd8" + name.encode()}])


@query(f"""{_KEYS} SELECT doc_id, 1 + k % 7 AS width, 2 AS height FROM keys WHERE k % 5 <> 4 UNION ALL SELECT doc_id, 2, 2 FROM keys WHERE k % 5 <> 4""")
def pdf_images(spark, sf_dir):
    """The images of scanned files; a file that isn't a PDF has none."""
    return PDF.extract_images(_files(spark, sf_dir, _scan)).where("error is null").select("doc_id", F.col("width").cast("long").alias("width"), "height")


def _png(key: int, name: str) -> bytes:
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    if key % 5 == 4:
        return b"no image"
    text = chunk(b"tEXt", b"Author\0" + name.encode()) + chunk(b"zTXt", b"Comment\0\0" + zlib.compress(b"x" * (3 << 20)))
    return IMG.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)) + text + chunk(b"IDAT", zlib.compress(bytes(4))) + chunk(b"IEND", b"")


@query(f"""{_KEYS} SELECT doc_id, 'Author' AS key, name AS text, CAST(length(name) AS BIGINT) AS size FROM keys WHERE k % 5 <> 4
UNION ALL SELECT doc_id, 'Comment', 'xxxx', 3145728 FROM keys WHERE k % 5 <> 4 UNION ALL SELECT doc_id, NULL, NULL, NULL FROM keys WHERE k % 5 = 4""")
def image_metadata(spark, sf_dir):
    """Texts of the containers, long ones whole; a file that can't be read is one row."""
    found = IMG.parse(_files(spark, sf_dir, _png, deal=True))
    key = F.try_element_at("attrs", F.lit("key"))
    return found.select("doc_id", key.alias("key"), F.when(key == "Comment", F.substring("text", 1, 4)).otherwise(F.col("text")).alias("text"), F.length("text").cast("long").alias("size"))


@query(f"{_KEYS} SELECT doc_id, CASE WHEN k % 5 <> 4 THEN 'tEXt,zTXt' END AS removed, CASE WHEN k % 5 <> 4 THEN 0 END AS kept, k % 5 = 4 AS failed FROM keys")
def image_scrubbed(spark, sf_dir):
    """Metadata blocks go, and reading the result finds none."""
    done = settle(IMG.scrub(_files(spark, sf_dir, _png)))
    left = IMG.parse(done.where("error is null").select("doc_id", "content")).groupBy("doc_id").agg(F.count("*").alias("n"))
    met = done.join(left, "doc_id", "left")
    return met.select("doc_id", F.array_join("removed", ",").alias("removed"), F.when(F.col("error").isNull(), F.coalesce(F.col("n"), F.lit(0)).cast("int")).alias("kept"), F.col("error").isNotNull().alias("failed"))


@query(f"""{_KEYS}, cells AS (SELECT doc_id, k, unnest(range(0, 64)) AS cell FROM keys)
SELECT doc_id, sha256(string_agg(CASE WHEN cell % 8 BETWEEN 2 AND 5 AND cell // 8 BETWEEN 2 AND 5 THEN '000000FF' ELSE printf('%02X%02X%02X%02X', k % 251, cell, 7, 9) END, '' ORDER BY cell)) AS digest FROM cells GROUP BY doc_id""")
def raster_redacted(spark, sf_dir):
    """A padded rectangle of every 8 by 8 image is black."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(map(str, keys), pa.string()), pa.array([b"".join(bytes((k % 251, cell, 7, 9)) for cell in range(64)) for k in keys], pa.binary())], names=["doc_id", "pixels"])

    images = _table(spark, sf_dir, "supplier").select("s_suppkey").mapInArrow(run, "doc_id string, pixels binary").select("doc_id", F.lit(8).alias("width"), F.lit(8).alias("height"), "pixels")
    box = F.struct(*[F.lit(v).cast("double").alias(n) for n, v in (("x", 4), ("y", 4), ("width", 0), ("height", 0))])
    ops = images.select("doc_id", F.lit("op").alias("op_id"), F.lit("blackout").alias("strategy"), box.alias("rect"))
    return raster.redact_rasters(images, ops).select("doc_id", F.sha2(F.hex("pixels"), 256).alias("digest"))


@query("""
SELECT lang, source, approx AS doc_kinds, docs FROM (
  SELECT lang, source, count(*) AS docs, count(DISTINCT n_chars) AS approx FROM documents GROUP BY ROLLUP (lang, source))""")
def length_report(spark, sf_dir):
    """Documents and distinct lengths by language and source, with subtotals."""
    rolled = _table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count_distinct("n_chars").alias("doc_kinds"), F.count("*").alias("docs"))
    return rolled.select("lang", "source", "doc_kinds", "docs")


@query("SELECT doc_id, length(text) + length(regexp_replace(text, '[^' || chr(65536) || '-' || chr(1114111) || ']', '', 'g')) AS utf16 FROM documents WHERE text IS NOT NULL")
def utf16_lengths(spark, sf_dir):
    docs = _docs(spark, sf_dir).where("text is not null")
    return docs.select("doc_id", C.utf16_offset(F.col("text"), F.length("text")).cast("long").alias("utf16"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's banner under the privacy policy, with what was found in it."""
    a = pipeline.analyze(_docs(spark, sf_dir), PRIVACY)
    found = a.findings.groupBy("doc_id").agg(F.count("*").alias("findings"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    return a.classified["documents"].join(found, "doc_id", "left").select("doc_id", "level", "banner", F.coalesce("findings", F.lit(0)).alias("findings"), F.coalesce("types", F.lit("")).alias("types"))
