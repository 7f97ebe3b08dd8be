"""Classification: findings to portion markings and document banners.

A policy is static, so its rules become boolean columns: one pass over the
findings per portion counts the matches of every rule, one pass over the
portions joins them to the document.  Levels join by maximum rank, union groups
by logical or of their values; rules assert union groups alone.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import RedactionError
from ..plans import lattice
from ..plans.policies import Mosaic, Policy, PolicyRule
from ..session import settle

DOUBLINGS = 32
PORTION_ROLES = ("paragraph", "heading", "title", "list-item", "table-cell", "caption", "footnote", "section", "header", "footer", "page")


def type_matches(types: tuple[str, ...], c: Column | None = None) -> Column:
    c = F.col("type") if c is None else c
    return reduce(lambda a, b: a | b, (F.startswith(c, F.lit(t[:-1])) if t.endswith(".*") else c == t for t in types), F.lit(False))


def portions_of(nodes: DataFrame, roles: tuple[str, ...] = PORTION_ROLES) -> DataFrame:
    """``(doc_id, node_id, portion, role, portion_ord)``: the nearest node upwards with a portion role, else the node itself.

    A round doubles the steps that every node has climbed, so a tree of any depth takes its logarithm of rounds; nodes
    that still climb after 2^``DOUBLINGS`` steps are each other's parents, which raises."""
    tree = nodes.select("doc_id", "node_id", "parent", "role", "ord")
    has_role = F.coalesce(F.col("role").isin(*roles), F.lit(False))
    now = tree.select(
        "doc_id", "node_id", F.when(has_role, F.col("node_id")).alias("portion"), F.when(has_role, F.col("role")).alias("p_role"), F.when(has_role, F.col("ord")).alias("p_ord"), F.when(~has_role, F.col("parent")).alias("climb")
    )
    if not nodes.where("parent is not null").isEmpty():
        now = settle(now)
        for _ in range(DOUBLINGS):
            if now.where("climb is not null").isEmpty():
                break
            up = now.toDF("u_doc", "u_node", "u_portion", "u_role", "u_ord", "u_climb")
            met = now.join(up, (F.col("doc_id") == F.col("u_doc")) & (F.col("climb") == F.col("u_node")), "left")
            now = settle(met.select("doc_id", "node_id", F.coalesce("portion", "u_portion").alias("portion"), F.coalesce("p_role", "u_role").alias("p_role"), F.coalesce("p_ord", "u_ord").alias("p_ord"), F.col("u_climb").alias("climb")))
        else:
            raise RedactionError("E_PARSE", "nodes are each other's parents")
    own = tree.select(F.col("doc_id").alias("o_doc"), F.col("node_id").alias("o_node"), F.col("role").alias("o_role"), F.col("ord").alias("o_ord"))
    met = now.join(own, (F.col("doc_id") == F.col("o_doc")) & (F.col("node_id") == F.col("o_node")))
    return met.select("doc_id", "node_id", F.coalesce("portion", "node_id").alias("portion"), F.coalesce("p_role", "o_role").alias("portion_role"), F.coalesce("p_ord", "o_ord").alias("portion_ord"))


def _fired(rule: PolicyRule) -> Column:
    match = type_matches(rule.types) & (F.col("confidence") >= rule.least)
    if rule.roles:
        match = match & F.coalesce(F.col("portion_role").isin(*rule.roles), F.lit(False))
    return F.count_if(match) >= rule.occurrences


def _distinct_types(m: Mosaic) -> Column:
    return F.count_distinct(F.when(type_matches(m.types), F.col("type"))) >= m.threshold


def _values(policy: Policy) -> list[str]:
    return [v.id for g in policy.groups for v in g.values]


def _asserted(policy: Policy, sources: list[tuple[str, str, dict]], base: Column) -> tuple[Column, dict[str, Column]]:
    """Rank and value columns from fired flags ``(column, level, markings)``."""
    rank = F.greatest(base, *[F.when(F.col(c), policy.level(level).rank).otherwise(-1) for c, level, _ in sources], F.lit(-1))
    marks = {}
    for v in _values(policy):
        flags = [F.col(c) for c, _, m in sources if any(v in ids for ids in m.values())]
        if flags:
            marks[v] = reduce(lambda a, b: a | b, flags)
    return rank, marks


def _settled(policy: Policy, rank: Column, marks: dict[str, Column]) -> dict[str, Column]:
    """Domination, then the values that the level doesn't permit go."""
    out = {}
    for v, on in marks.items():
        for other, there in marks.items():
            if v in policy.value(other).dominates:
                on = on & ~there
        least = policy.value(v).minimum
        out[v] = on & (rank >= policy.level(least).rank) if least else on
    return out


def _text(policy: Policy, rank: Column, marks: dict[str, Column], full: bool) -> Column:
    level = F.lit(None).cast("string")
    for x in policy.levels:
        level = F.when(rank == x.rank, x.name if full else x.short).otherwise(level)
    parts = [level]
    for g in policy.groups:
        present = [F.when(marks[v.id], v.name if full else v.short) for v in g.values if v.id in marks]
        if present:
            joined = F.array_join(F.array_compact(F.array(*present)), g.separator)
            parts.append(F.when(joined != "", F.concat(F.lit(g.prefix), joined, F.lit(g.suffix))))
    body = F.concat_ws(policy.separator, *parts)
    body = F.upper(body) if policy.uppercase else body
    return body if full else F.concat(F.lit(policy.delimiters[0]), body, F.lit(policy.delimiters[1]))


def _ids(policy: Policy, marks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(marks[v], v) for v in _values(policy) if v in marks])) if marks else F.array().cast("array<string>")


def eligible(found: DataFrame, nodes: DataFrame, least: float = 0.5, roles: tuple[str, ...] = PORTION_ROLES) -> DataFrame:
    """Findings sure enough to count, with their portion."""
    where = portions_of(nodes, roles).select(F.col("doc_id").alias("w_doc"), F.col("node_id").alias("w_node"), "portion", "portion_role", "portion_ord")
    met = found.where(F.col("confidence") >= least).join(where, (F.col("doc_id") == F.col("w_doc")) & (F.col("node_id") == F.col("w_node")), "left").drop("w_doc", "w_node")
    return met.withColumn("portion", F.coalesce("portion", "node_id"))


def classify_portions(policy: Policy, sure: DataFrame) -> DataFrame:
    """``(doc_id, portion, portion_ord, rank, level, markings, marking, basis, n_findings)`` of ``eligible`` findings."""
    rules = [(f"r{i}", r) for i, r in enumerate(policy.rules)]
    mosaic = [(f"m{i}", m) for i, m in enumerate(policy.mosaic) if m.scope == "portion"]
    flags = sure.groupBy("doc_id", "portion").agg(
        F.min("portion_ord").alias("portion_ord"), F.count("*").alias("n_findings"), *[_fired(r).alias(c) for c, r in rules], *[_distinct_types(m).alias(c) for c, m in mosaic]
    )
    any_rule = reduce(lambda a, b: a | b, (F.col(c) for c, _ in rules), F.lit(False))
    base = F.when(any_rule, policy.bottom.rank).otherwise(policy.level(policy.default).rank)
    sources = [(c, x.level, x.markings) for c, x in [*rules, *mosaic]]
    rank, marks = _asserted(policy, sources, base)
    ranked = flags.withColumn("rank", rank)
    settled = _settled(policy, F.col("rank"), marks)
    level = F.lit(None).cast("string")
    for x in policy.levels:
        level = F.when(F.col("rank") == x.rank, x.id).otherwise(level)
    basis = F.array_compact(F.array(*[F.when(F.col(c), x.id) for c, x in [*rules, *mosaic]]))
    return ranked.select(
        "doc_id", "portion", "portion_ord", "rank", level.alias("level"), _ids(policy, settled).alias("markings"), _text(policy, F.col("rank"), settled, False).alias("marking"), basis.alias("basis"), "n_findings"
    )


def classify_documents(policy: Policy, docs: DataFrame, sure: DataFrame, portions: DataFrame) -> DataFrame:
    """``(doc_id, rank, level, markings, banner, mosaic, n_portions)`` for every ``docs(doc_id)``; one without findings has the lowest level."""
    asserting = {v for x in [*policy.rules, *policy.mosaic] for ids in x.markings.values() for v in ids}
    joined = portions.groupBy("doc_id").agg(
        F.max("rank").alias("p_rank"), F.count("*").alias("n_portions"), *[F.max(F.array_contains("markings", v)).alias(f"v{i}") for i, v in enumerate(_values(policy)) if v in asserting]
    )
    mosaic = [(f"d{i}", m) for i, m in enumerate(policy.mosaic) if m.scope == "document"]
    met = docs.select(F.col("doc_id").cast("string").alias("doc_id")).join(joined, "doc_id", "left")
    if mosaic:
        met = met.join(sure.groupBy("doc_id").agg(*[_distinct_types(m).alias(c) for c, m in mosaic]), "doc_id", "left")
    off = F.lit(False)
    for c, _ in mosaic:
        met = met.withColumn(c, F.coalesce(c, off))
    rank, marks = _asserted(policy, [(c, m.level, m.markings) for c, m in mosaic], F.coalesce("p_rank", F.lit(policy.bottom.rank)))
    for i, v in enumerate(_values(policy)):
        if v in asserting:
            marks[v] = marks.get(v, off) | F.coalesce(F.col(f"v{i}"), off)
    ranked = met.withColumn("rank", rank)
    settled = _settled(policy, F.col("rank"), marks)
    level = F.lit(None).cast("string")
    for x in policy.levels:
        level = F.when(F.col("rank") == x.rank, x.id).otherwise(level)
    fired = F.array_compact(F.array(*[F.when(F.col(c), m.id) for c, m in mosaic])) if mosaic else F.array().cast("array<string>")
    return ranked.select(
        "doc_id", "rank", level.alias("level"), _ids(policy, settled).alias("markings"), _text(policy, F.col("rank"), settled, True).alias("banner"), fired.alias("mosaic"), F.coalesce("n_portions", F.lit(0)).cast("long").alias("n_portions")
    )


# ---- declared markings

_DECLARED = "doc_id string, declared string, under_marked boolean, over_marked boolean, missing array<string>, unsupported array<string>, warnings array<string>"


def _declared(policy: Policy, mode: str):
    def run(batches):
        for batch in batches:
            rows = []
            for doc, texts, level, marks in zip(*(batch.column(i).to_pylist() for i in range(4))):
                parsed, warnings = [], []
                for text in texts:
                    assertion, unknown, named = lattice.parse(policy, text)
                    if not named:
                        w = f"foreign-marking:{text.upper()}"
                        warnings += [w] if w not in warnings else []
                        continue
                    if unknown:
                        warnings.append("unparsed-marking:" + ",".join(unknown))
                    parsed.append(assertion)
                if not parsed:
                    rows.append((doc, None, None, None, None, None, warnings))
                    continue
                declared = lattice.join_all(policy, parsed, mode)
                derived = level, {g.id: t for g in policy.groups if (t := tuple(v.id for v in g.values if v.id in marks))}
                c = lattice.compare(policy, declared, derived)
                warnings += ["under-marked"] * c["under_marked"] + ["over-marked"] * c["over_marked"]
                rows.append((doc, lattice.render(policy, declared), c["under_marked"], c["over_marked"], c["missing"], c["unsupported"], warnings))
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), *[pa.list_(pa.string())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "declared", "under_marked", "over_marked", "missing", "unsupported", "warnings"])

    return run


def declared_markings(policy: Policy, found: DataFrame, documents: DataFrame, mode: str = "parity") -> DataFrame:
    """What documents say of themselves against what their content asks for; reads all resolved banner findings."""
    banners = found.where("type = 'marking.banner'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "start", F.coalesce("normalized", "value").alias("t")))).alias("b"))
    met = banners.join(documents.select("doc_id", "level", "markings"), "doc_id").select("doc_id", F.col("b.t").alias("t"), "level", "markings")
    return met.mapInArrow(_declared(policy, mode), _DECLARED)


def warnings(policy: Policy, sure: DataFrame, portions: DataFrame, documents: DataFrame, declared: DataFrame) -> DataFrame:
    """``(doc_id, portion, code, detail)``: one row a warning."""
    ids = [m.id for m in policy.mosaic]
    a = portions.select("doc_id", "portion", F.explode(F.filter("basis", lambda x: x.isin(*ids) if ids else F.lit(False))).alias("detail"))
    b = documents.select("doc_id", F.lit(None).cast("string").alias("portion"), F.explode("mosaic").alias("detail"))
    c = declared.select("doc_id", F.lit(None).cast("string").alias("portion"), F.explode("warnings").alias("w"))
    code = F.lit("mosaic-risk")
    head = F.split("w", ":", 2)
    return a.union(b).select("doc_id", "portion", code.alias("code"), "detail").union(c.select("doc_id", "portion", head[0].alias("code"), F.coalesce(F.get(head, F.lit(1)), F.lit("")).alias("detail")))


def classify(policy: Policy, docs: DataFrame, nodes: DataFrame, found: DataFrame, least: float = 0.5) -> dict[str, DataFrame]:
    sure = settle(eligible(found, nodes, least))
    portions = settle(classify_portions(policy, sure))
    documents = settle(classify_documents(policy, docs, sure, portions))
    declared = settle(declared_markings(policy, found, documents))
    return {"eligible": sure, "portions": portions, "documents": documents, "declared": declared, "warnings": warnings(policy, sure, portions, documents, declared)}
