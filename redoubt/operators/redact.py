"""Planning, applying and verifying redactions."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RedactionError
from ..functions import columns as C
from ..session import settle
from . import search

MARKER = "[REDACTED]"


@dataclass(frozen=True)
class Strategy:
    id: str
    applies: tuple[str, ...]
    destructive: bool = True
    recovery: str = "none"  # none, by-design, recoverable


# Strategies and release reasons.  The averaging mosaic is kept out of the safe set:
# its block means can be computed back; the noise variant is "noise-mosaic".
STRATEGIES = {
    s.id: s
    for s in (
        Strategy("remove", ("text", "node")),
        Strategy("replace", ("text", "node")),
        Strategy("mask", ("text",), recovery="by-design"),
        Strategy("pseudonymize", ("text",)),
        Strategy("synthesize", ("text",)),
        Strategy("blackout", ("region",)),
        Strategy("blur", ("region",), False, "recoverable"),
        Strategy("pixelate", ("region",), False, "recoverable"),
        Strategy("scramble", ("region",)),
        Strategy("hatch", ("region",)),
        Strategy("synthetic-mosaic", ("region",), False, "recoverable"),
        Strategy("noise-mosaic", ("region",)),
    )
}
FOIA = {
    "b1": "classified national defense or foreign policy information",
    "b2": "internal personnel rules and practices",
    "b3": "specifically exempted by other statute",
    "b4": "trade secrets and confidential commercial information",
    "b5": "privileged inter-agency or intra-agency memoranda",
    "b6": "personnel and medical files; clearly unwarranted invasion of personal privacy",
    "b7a": "law enforcement records; interference with proceedings",
    "b7c": "law enforcement records; unwarranted invasion of personal privacy",
    "b7d": "law enforcement records; confidential source",
    "b7e": "law enforcement techniques and procedures",
    "b7f": "law enforcement records; endangerment of an individual",
    "b8": "financial institution examination records",
    "b9": "geological and geophysical information concerning wells",
}
LABELS = {
    "person.name": "PERSON", "contact.email": "EMAIL", "contact.phone": "PHONE", "contact.address": "ADDRESS", "gov.ssn": "SSN", "financial.card": "CARD", "financial.iban": "IBAN",
    "net.ipv4": "IP", "net.ipv6": "IP", "org.name": "ORG", "secret.api-key": "KEY",
}


def foia(key: str) -> tuple[str, str]:
    section = key[:2] + "".join(f"({c})" for c in key[2:].upper())
    return f"foia.{key}", f"5 USC 552(b)({section[1:2]}){section[2:]} - {FOIA[key]}"


def permitted(strategy: str, allow_recoverable: bool = False) -> None:
    """Raise for an unknown strategy and, unless allowed, for one that can be reversed."""
    if strategy not in STRATEGIES:
        raise RedactionError("E_USAGE", f"unknown strategy {strategy}")
    if STRATEGIES[strategy].recovery == "recoverable" and not allow_recoverable:
        raise RedactionError("E_COSMETIC_REFUSED", f"{strategy} leaves what it covers recoverable")


# ---- pseudonyms


def derive_key(passphrase: str, salt: bytes, rounds: int = 20_000) -> bytes:
    out = salt + passphrase.encode()
    for _ in range(rounds):
        out = hashlib.sha256(out).digest()
    return out


def pseudonym(key: bytes, kind: str, value: str, normalized: str | None = None) -> str:
    """``LABEL_XXXXXX``, the same for a value in any case; the normalised form wins."""
    folded = (normalized or value).strip().lower()
    import base64

    tag = base64.b32encode(hmac.new(key, f"{kind}\0{folded}".encode(), hashlib.sha256).digest())[:6].decode()
    return f"{LABELS.get(kind, kind.rpartition('.')[2].upper().replace('-', '_'))}_{tag}"


def pseudonyms(key: bytes):
    """A pandas UDF of (type, value, normalized); the key stays in its closure and out of plans."""
    if len(key) < 16:
        raise RedactionError("E_USAGE", "a pseudonym key needs at least 16 bytes")

    @F.pandas_udf("string")
    def run(kind: pd.Series, value: pd.Series, normalized: pd.Series) -> pd.Series:
        return pd.Series([pseudonym(key, k, v, n) for k, v, n in zip(kind, value, normalized)], dtype=object)

    return run


def reidentification(found: DataFrame, key: bytes) -> DataFrame:
    """Token to folded value; to be kept as restricted as the key."""
    folded = F.lower(F.trim(F.coalesce("normalized", "value")))
    return found.select(pseudonyms(key)("type", "value", "normalized").alias("token"), folded.alias("value")).distinct()


# ---- planning


@dataclass(frozen=True)
class PlanOptions:
    least: float = 0.5
    by_type: dict[str, str] = field(default_factory=dict)
    default: str = "replace"
    marker: str = MARKER
    key: bytes | None = None
    keep: int = 4
    keep_side: str = "end"
    allow_recoverable: bool = False
    reason: tuple[str, str] = ("policy.sensitive-content", "Policy determination")
    reasons_by_type: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: Of the columns of a finding: the text of a replacement, and code and authority of a reason; null leaves the rest to decide.
    replacement_text: Callable[[], Column] | None = None
    reason_for: Callable[[], tuple[Column, Column]] | None = None


def _by_type(table: dict[str, str]) -> Column:
    """Exact type first, then the longest prefix pattern."""
    out = F.lit(None).cast("string")
    for pattern in sorted((t for t in table if t.endswith(".*")), key=len):
        out = F.when(F.startswith(F.col("type"), F.lit(pattern[:-1])), table[pattern]).otherwise(out)
    for exact in (t for t in table if not t.endswith(".*")):
        out = F.when(F.col("type") == exact, table[exact]).otherwise(out)
    return out


def synthesize() -> Column:
    """A made-up value of the same type, from the SHA-256 of the finding's id."""
    seed = F.sha2("id", 256)
    byte = lambda i: F.conv(F.substring(seed, 2 * (i % 32) + 1, 2), 16, 10).cast("int")
    digits = lambda n, at=0: F.concat(*[(byte(at + i) % 10).cast("string") for i in range(n)])
    return (
        F.when(F.col("type") == "contact.email", F.concat(F.lit("user"), digits(4), F.lit("@example.invalid")))
        .when(F.col("type") == "contact.phone", F.concat(F.lit("+1555010"), digits(4)))
        .when(F.col("type") == "gov.ssn", F.concat(F.lit("9"), digits(2), F.lit("-"), digits(2, 4), F.lit("-"), digits(4, 8)))
        .when(F.col("type") == "financial.card", F.concat(F.lit("4000"), digits(12, 2)))
        .when(F.col("type") == "net.ipv4", F.concat(F.lit("192.0.2."), (byte(0) % 254 + 1).cast("string")))
        .when(F.col("type") == "person.name", F.concat(F.lit("Person "), C.base32(seed, 4)))
        .when(F.col("type") == "geo.coordinates", F.lit("0.0000, 0.0000"))
        .otherwise(F.concat(F.lit("[SYNTHETIC:"), F.substring(C.base32(seed, 8), 1, 6), F.lit("]")))
    )


def plan(nodes: DataFrame, sure: DataFrame, portions: DataFrame, options: PlanOptions = PlanOptions(), exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(operations, retained)``: what to do to each place, and how many copies of excluded values stay.

    Operations: ``doc_id, op_id, loc_kind, node_id, start, end, location, strategy,
    replacement, reason_code, authority, finding_ids, original``; they hold the
    originals and belong in a restricted place.  ``retained``: ``doc_id, key, n``.
    """
    for s in {options.default, *options.by_type.values()}:
        permitted(s, options.allow_recoverable)
    if "pseudonymize" in {options.default, *options.by_type.values()} and options.key is None:
        raise RedactionError("E_USAGE", "pseudonymize needs a key")
    marks = portions.select(F.col("doc_id").alias("m_doc"), F.col("portion").alias("m_portion"), "markings")
    f = sure.where(F.col("confidence") >= options.least).join(marks, (F.col("doc_id") == F.col("m_doc")) & (F.col("portion") == F.col("m_portion")), "left").drop("m_doc", "m_portion")
    if exclude is None:
        retained = f.select("doc_id", F.lit("").alias("key")).limit(0).groupBy("doc_id", "key").agg(F.count("*").alias("n"))
    else:
        out = exclude.select(F.col("doc_id").alias("x_doc"), F.col("id").alias("x_id")).distinct()
        same = (F.col("doc_id") == F.col("x_doc")) & (F.col("id") == F.col("x_id"))
        retained = f.join(out, same, "left_semi").select("doc_id", C.retain_key(F.col("value")).alias("key")).where("key <> ''").groupBy("doc_id", "key").agg(F.count("*").alias("n"))
        f = f.join(out, same, "left_anti")
    f = f.where(~F.col("type").isin("marking.banner", "marking.portion"))
    f = f.withColumn("location", C.location_key(F.col("loc_kind"), F.col("node_id"), F.col("start"), F.col("end")))
    first = Window.partitionBy("doc_id", "location").orderBy("portion_ord", "node_id", F.coalesce("start", F.lit(-1)), F.desc("confidence"), "id")
    f = settle(f.withColumn("rn", F.row_number().over(first)).where("rn = 1"))
    has = lambda v: F.coalesce(F.array_contains("markings", v), F.lit(False))
    chosen = F.coalesce(_by_type(options.by_type), F.when((F.col("loc_kind") == "node") & F.startswith("type", F.lit("risk.")), "remove")).alias("s")
    auto = F.when(has("no-publish"), "replace").when(has("pseudonymized") & F.lit(options.key is not None), "pseudonymize").when(has("aggregate-only"), "replace").otherwise(options.default)
    f = f.withColumn("strategy", F.coalesce(chosen, auto))
    applies = F.create_map(*[x for s in STRATEGIES.values() for x in (F.lit(s.id), F.array(*map(F.lit, s.applies)))])
    illegal = ~F.array_contains(F.element_at(applies, F.col("strategy")), F.col("loc_kind"))
    f = f.withColumn("error", F.when(illegal, F.concat(F.lit("E_UNSUPPORTED: "), "strategy", F.lit(" on a "), "loc_kind")))
    token = pseudonyms(options.key)("type", "value", "normalized") if options.key else F.lit(None).cast("string")
    text = (
        F.when(F.col("strategy") == "replace", F.coalesce(options.replacement_text() if options.replacement_text else F.lit(None).cast("string"), F.lit(options.marker))).when(F.col("strategy") == "pseudonymize", token).when(F.col("strategy") == "mask", C.mask_value(F.col("value"), options.keep, options.keep_side)).when(F.col("strategy") == "synthesize", synthesize())
    )
    code, authority = F.lit(options.reason[0]), F.lit(options.reason[1])
    for kind, (c, a) in options.reasons_by_type.items():
        code, authority = F.when(type_like(kind), c).otherwise(code), F.when(type_like(kind), a).otherwise(authority)
    manual = F.startswith("rule_id", F.lit("manual:"))
    code, authority = F.when(manual, "operator.marked").otherwise(code), F.when(manual, "Marked by the operator who reviewed the document").otherwise(authority)
    if options.reason_for:
        own_code, own_authority = options.reason_for()
        code, authority = F.coalesce(own_code, code), F.coalesce(own_authority, authority)
    ops = f.select(
        "doc_id", C.content_id("op_", F.col("id"), F.col("strategy")).alias("op_id"), "loc_kind", "node_id", "start", "end", "location", "strategy", text.alias("replacement"),
        code.alias("reason_code"), authority.alias("authority"),
        F.array("id").alias("finding_ids"), F.col("value").alias("original"), "error",
    )
    return merge_overlapping(ops, nodes), retained


def type_like(kind: str) -> Column:
    return F.startswith("type", F.lit(kind[:-1])) if kind.endswith(".*") else F.col("type") == kind


def islands(spans: DataFrame, keys: list[str], adjacent: bool = True) -> DataFrame:
    """``spans`` with ``island``: spans of a key that overlap or, if ``adjacent``, touch share a number."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("start") > F.col("reach") if adjacent else F.col("start") >= F.col("reach")
    return spans.withColumn("reach", reach).withColumn("island", F.sum(F.when(F.col("reach").isNull() | new, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("reach")


def merge_intervals(spans: DataFrame, keys: list[str], adjacent: bool = True) -> DataFrame:
    return islands(spans, keys, adjacent).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("members")).drop("island")


def complement(merged: DataFrame, keys: list[str], length: DataFrame) -> DataFrame:
    """The gaps that merged spans leave in ``[0, length)``; ``length`` has the keys and ``length``."""
    order = Window.partitionBy(*keys).orderBy("start")
    gaps = merged.select(*keys, F.coalesce(F.lag("end").over(order), F.lit(0)).alias("g0"), F.col("start").alias("g1"))
    tails = length.join(merged.groupBy(*keys).agg(F.max("end").alias("last")), keys, "left").select(*keys, F.coalesce("last", F.lit(0)).alias("g0"), F.col("length").cast("int").alias("g1"))
    return gaps.union(tails).where("g0 < g1").select(*keys, F.col("g0").alias("start"), F.col("g1").alias("end"))


def merge_overlapping(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """Text operations that overlap or touch become one ``replace``; a marker they share stays."""
    text = islands(ops.where("loc_kind = 'text'"), ["doc_id", "node_id"])
    members = F.array_sort(F.collect_list(F.struct("start", "end", "op_id", "strategy", "replacement", "reason_code", "authority", "finding_ids", "original", "location"))).alias("m")
    grouped = text.groupBy("doc_id", "node_id", "island").agg(members, F.min("start").alias("g0"), F.max("end").alias("g1"), F.max("error").alias("error"))
    one = grouped.where("size(m) = 1").select("doc_id", F.col("m")[0].alias("x"), "node_id", "error").select(
        "doc_id", "x.op_id", F.lit("text").alias("loc_kind"), "node_id", "x.start", "x.end", "x.location", "x.strategy", "x.replacement", "x.reason_code", "x.authority", "x.finding_ids", "x.original", "error"
    )
    texts = nodes.select(F.col("doc_id").alias("t_doc"), F.col("node_id").alias("t_node"), "text")
    many = grouped.where("size(m) > 1").join(texts, (F.col("doc_id") == F.col("t_doc")) & (F.col("node_id") == F.col("t_node")))
    ids = F.array_distinct(F.flatten(F.transform("m", lambda x: x["finding_ids"])))
    markers = F.array_distinct(F.transform(F.filter("m", lambda x: (x["strategy"] == "replace") & x["replacement"].isNotNull()), lambda x: x["replacement"]))
    fused = many.select(
        "doc_id", C.content_id("op_", F.array_join(ids, "+"), F.lit("merged")).alias("op_id"), F.lit("text").alias("loc_kind"), "node_id", F.col("g0").alias("start"), F.col("g1").alias("end"),
        C.location_key(F.lit("text"), F.col("node_id"), F.col("g0"), F.col("g1")).alias("location"), F.lit("replace").alias("strategy"),
        F.when(F.size(markers) == 1, markers[0]).otherwise(MARKER).alias("replacement"), F.col("m")[0]["reason_code"].alias("reason_code"),
        F.array_join(F.array_distinct(F.transform("m", lambda x: x["authority"])), "; ").alias("authority"), ids.alias("finding_ids"),
        F.substring("text", F.col("g0") + 1, F.col("g1") - F.col("g0")).alias("original"), "error",
    )
    return one.unionByName(fused).unionByName(ops.where("loc_kind <> 'text'"))


def digests(nodes: DataFrame, name: str = "digest") -> DataFrame:
    """``(doc_id, digest)`` over a document's nodes: each node's text is hashed where it lies, the hashes in order once more."""
    own = nodes.select("doc_id", F.struct("ord", "node_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("of_text"), F.col("text").isNull().alias("none")).alias("n"))
    return own.groupBy("doc_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("n"))), 256).alias(name))


def plans(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(doc_id, plan_id, source_digest, operations)``: a plan's name follows from its operations and the document it was made for."""
    listed = ops.groupBy("doc_id").agg(F.array_sort(F.collect_list("op_id")).alias("ids"))
    met = digests(nodes, "source_digest").join(listed, "doc_id")
    return met.select("doc_id", C.content_id("plan_", F.col("source_digest"), F.array_join("ids", " ")).alias("plan_id"), "source_digest", F.size("ids").cast("long").alias("operations"))


def stale(made: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(doc_id, plan_id, error)`` of ``plans`` whose document isn't the one in ``nodes`` any more."""
    met = made.join(digests(nodes, "now"), "doc_id", "left").where(~F.col("now").eqNullSafe(F.col("source_digest")))
    return met.select("doc_id", "plan_id", F.lit("E_DIGEST").alias("error"))


def validate(ops: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(doc_id, op_id, error)``: targets that don't exist, spans beyond their text, illegal strategies, overlaps."""
    target = nodes.select(F.col("doc_id").alias("t_doc"), F.col("node_id").alias("t_node"), F.length("text").alias("n"))
    met = ops.join(target, (F.col("doc_id") == F.col("t_doc")) & (F.col("node_id") == F.col("t_node")), "left")
    after = F.lead("start").over(Window.partitionBy("doc_id", "node_id", "loc_kind").orderBy("start", "end"))
    met = met.withColumn("after", after)
    error = (
        F.when(F.col("t_node").isNull(), "E_DANGLING").when((F.col("loc_kind") == "text") & ((F.col("start") < 0) | (F.col("start") >= F.col("end")) | (F.col("end") > F.col("n"))), "E_RANGE")
        .when(F.col("error").isNotNull(), F.col("error")).when((F.col("loc_kind") == "text") & (F.col("after") < F.col("end")), "E_CONFLICT")
    )
    return met.select("doc_id", "op_id", error.alias("error")).where("error is not null")


# ---- applying


def apply(nodes: DataFrame, ops: DataFrame) -> DataFrame:
    """The nodes with all operations done: texts spliced, removed nodes gone.

    A text is built in one fold over its sorted operations, so its cost is
    linear in text and operations."""
    spans = ops.where("loc_kind = 'text'").groupBy(F.col("doc_id").alias("o_doc"), F.col("node_id").alias("o_node")).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.coalesce("replacement", F.lit("")).alias("r")))).alias("ops"))
    whole = ops.where("loc_kind = 'node'").groupBy(F.col("doc_id").alias("w_doc"), F.col("node_id").alias("w_node")).agg(F.max(F.col("strategy") == "remove").alias("removed"), F.max("replacement").alias("w_text"))
    met = nodes.join(spans, (F.col("doc_id") == F.col("o_doc")) & (F.col("node_id") == F.col("o_node")), "left").join(whole, (F.col("doc_id") == F.col("w_doc")) & (F.col("node_id") == F.col("w_node")), "left")
    done = splice(F.col("text"), F.col("ops"))
    text = F.when(F.col("w_text").isNotNull(), F.col("w_text")).when(F.col("ops").isNotNull(), done).otherwise(F.col("text"))
    return met.where(~F.coalesce("removed", F.lit(False))).withColumn("text", text).select(*nodes.columns)


def splice(text: Column, ops: Column) -> Column:
    """``text`` with sorted, disjoint ``array<struct<start,end,r>>`` replaced."""
    starts = F.concat(F.array(F.lit(0)), F.transform(ops, lambda x: x["end"]))
    pieces = F.transform(ops, lambda x, i: F.concat(F.substring(text, F.element_at(starts, i + 1) + 1, x["start"] - F.element_at(starts, i + 1)), x["r"]))
    last = F.element_at(starts, -1)
    return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))


def map_offset(offset: Column, ops: Column) -> Column:
    """Where an offset of the original text lies in the spliced one; one inside a replaced span moves to its start."""
    shift = F.aggregate(F.filter(ops, lambda x: x["end"] <= offset), F.lit(0), lambda a, x: (a + F.length(x["r"]) - (x["end"] - x["start"])).cast("int"))
    inside = F.filter(ops, lambda x: (x["start"] < offset) & (offset < x["end"]))
    return F.when(F.size(inside) > 0, inside[0]["start"]).otherwise(offset) + shift


# ---- verifying


def verify(ops: DataFrame, retained: DataFrame, output: DataFrame, short: int = 4, degraded: bool = False, documents: DataFrame | None = None) -> dict[str, DataFrame]:
    """``leaks``, ``unverifiable`` and one ``report`` row per document with operations, or per one of ``documents``.

    Every promised removal is searched in every text of the output document:
    each distinct value once, all of a document's values in one pass over a
    text; more occurrences than the retained copies are a leak."""
    spec = {s.id: s.recovery for s in STRATEGIES.values()}
    recovery = F.element_at(F.create_map(*[F.lit(x) for kv in spec.items() for x in kv]), F.col("strategy"))
    o = ops.withColumn("recovery", recovery)
    nodes = output.select(F.col("doc_id").alias("n_doc"), F.col("node_id").alias("n_node"), "kind", "ord", "text", "attrs")
    channel = F.when(F.col("kind").isin("metadata", "annotation", "attachment"), F.col("kind")).when(F.try_element_at("attrs", F.lit("revision")).isNotNull(), "revision-history").otherwise("text-layer")
    searchable = (F.length(F.trim("original")) > 0) & F.col("original").isNotNull()
    reason = F.when(F.col("recovery") == "recoverable", "recoverable strategy").when(~F.coalesce(searchable, F.lit(False)), "no original value").when(F.col("recovery") == "by-design", "part stays by design")
    live = o.where("loc_kind = 'node' and strategy = 'remove'").join(nodes, (F.col("doc_id") == F.col("n_doc")) & (F.col("node_id") == F.col("n_node")))
    survivors = live.select("doc_id", "op_id", F.col("n_node").alias("found_in"), channel.alias("channel"), C.preview(F.coalesce("text", "n_node")).alias("preview"))
    gone = o.join(survivors.select(F.col("doc_id").alias("v_doc"), F.col("op_id").alias("v_op")), (F.col("doc_id") == F.col("v_doc")) & (F.col("op_id") == F.col("v_op")), "left_anti")
    unverifiable = gone.select("doc_id", "op_id", reason.alias("reason")).where("reason is not null")
    allowed = retained.select(F.col("doc_id").alias("k_doc"), F.col("key").alias("k_key"), F.col("n").alias("allowed"))
    sought = gone.where(reason.isNull()).select("doc_id", "op_id", "original", C.search_key(F.col("original")).alias("needle"), C.retain_key(F.col("original")).alias("r_key")).where("needle <> ''")
    sought = sought.join(allowed, (F.col("doc_id") == F.col("k_doc")) & (F.col("r_key") == F.col("k_key")), "left")
    sought = sought.withColumn("whole", F.length(F.trim("original")) < short)
    texts = nodes.where("length(text) > 0").select("n_doc", "n_node", C.search_key(F.col("text")).alias("hay"))
    seen = search.counts(texts.toDF("doc_id", "node_id", "hay"), sought.select("doc_id", "needle", "whole")).toDF("s_doc", "n_node", "s_needle", "s_whole", "seen")
    same = (F.col("doc_id") == F.col("s_doc")) & (F.col("needle") == F.col("s_needle")) & (F.col("whole") == F.col("s_whole"))
    met = sought.join(seen, same).join(nodes.select(F.col("n_doc").alias("t_doc"), F.col("n_node").alias("t_node"), "kind", "ord", "attrs"), (F.col("doc_id") == F.col("t_doc")) & (F.col("n_node") == F.col("t_node")))
    running = F.sum("seen").over(Window.partitionBy("doc_id", "op_id").orderBy("ord", "n_node").rowsBetween(Window.unboundedPreceding, 0))
    over = met.withColumn("running", running).where(F.col("running") > F.coalesce("allowed", F.lit(0)))
    first = over.groupBy("doc_id", "op_id").agg(F.min_by(F.struct(F.col("n_node").alias("found_in"), channel.alias("channel"), C.preview(F.col("original")).alias("preview")), "running").alias("x"))
    from .detect import opaque_over_text

    covered = opaque_over_text(output, None)
    overlay = covered.groupBy("doc_id", "node_id").agg(F.min_by("shape_id", "shape_ord").alias("shape_id"), F.first("text").alias("text"))
    overlay = overlay.select("doc_id", F.concat(F.lit("overlay:"), "shape_id").alias("op_id"), F.col("node_id").alias("found_in"), F.lit("underlying-raster").alias("channel"), C.preview(F.col("text")).alias("preview"))
    unverifiable = settle(unverifiable)
    leaks = survivors.union(first.select("doc_id", "op_id", "x.found_in", "x.channel", "x.preview")).union(overlay)
    leaks = settle(leaks)
    counted = ops.groupBy("doc_id").agg(F.count("*").alias("operations"))
    if documents is not None:
        counted = documents.select(F.col("doc_id").cast("string").alias("doc_id")).distinct().join(counted, "doc_id", "left")
    totals = counted.join(leaks.groupBy("doc_id").agg(F.count("*").alias("n_leaks")), "doc_id", "full").join(unverifiable.groupBy("doc_id").agg(F.count("*").alias("n_unverifiable")), "doc_id", "left")
    zero = F.lit(0).cast("long")
    report = totals.select("doc_id", F.coalesce("operations", zero).alias("operations"), F.coalesce("n_leaks", zero).alias("leaks"), F.coalesce("n_unverifiable", zero).alias("unverifiable")).withColumn("passed", F.col("leaks") == 0).withColumn("degraded", F.lit(degraded))
    report = report.withColumn("defensible", F.col("passed") & (F.col("unverifiable") == 0) & ~F.col("degraded")).withColumn("status", F.when(F.col("passed"), "released").otherwise("refused"))
    return {"leaks": leaks, "unverifiable": unverifiable, "report": report}


def merge_reports(reports: DataFrame) -> DataFrame:
    return reports.agg(F.bool_and("passed").alias("passed"), F.sum("leaks").alias("leaks"), F.sum("operations").alias("operations"), F.sum("unverifiable").alias("unverifiable"))


def released(output: DataFrame, report: DataFrame) -> DataFrame:
    """The output without refused documents."""
    return output.join(report.where("status = 'refused'").select("doc_id"), "doc_id", "left_anti")


