"""Mixing sources to target weights.

Tokens are summed per source, the targets are filled up by weight, and every
document is emitted floor(rate) times plus one Bernoulli copy whose draw is a
hash of the document, so reruns agree.

Definitions: sources go by code point, null last, and weigh 3, 1, 2, repeating.
The draw is a hash of ``doc_id`` and text (a null one is empty), so only rows
that repeat both share it.  A source without words has target 0 and its
documents are not taken; null, empty and blank texts have size 0 and may still
be taken.  An empty table has an empty mix.  The mix holds all columns of its
input, whatever their names.

The weight pattern needs a source's rank, found from a range sort of the source
totals, so neither the number of sources nor that of documents is bounded.
Targets are broadcast while they are few and short, which is counted first, so
that documents stay where they are; beyond that both sides are shuffled and the
skew join splits a hot source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE_NUM, SHARE_DEN = 3, 2  # the mix holds 150 % of all words
MOST = 2  # times a source's own words
SEED = "mix-2:"
BROADCAST_ROWS, BROADCAST_CHARS = 100_000, 4_000_000  # of all sources' names

_WORDS = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long"))


def _ranked(totals: DataFrame) -> DataFrame:
    """``rank`` from 0 by code point, null last: ranks within range partitions plus the sizes of those before."""
    parts = common.checkpoint(
        totals.repartitionByRange(common.partitions(totals.sparkSession), F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    )
    before, at = {}, 0
    for r in sorted(parts.groupBy("part").count().collect()):  # one row a partition
        before[r["part"]] = at
        at += r["count"]
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("rank", within + F.element_at(offset, F.col("part")))


def source_targets(docs: DataFrame) -> DataFrame:
    """``(source, source_size, target)``: weights share the mix, and what a
    source cannot take within MOST times its words is shared again by weight
    until no source is above."""
    totals = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    stats = common.checkpoint(_ranked(totals).select("source", "source_size", weight.alias("w")))
    whole = stats.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:  # a round caps at least one more source; totals only reach the driver
        full = F.lit(False) if level is None else F.col("w") * F.lit(level) > MOST * F.col("source_size")
        capped, weights = stats.agg(F.sum(F.when(full, MOST * F.col("source_size"))), F.sum(F.when(~full, F.col("w")))).first()
        raised = (SHARE_NUM * whole / SHARE_DEN - (capped or 0)) / weights if weights else 0.0
        if raised == level:
            break
        level = raised
    return stats.select("source", "source_size", F.least(F.col("w") * F.lit(float(level)), (MOST * F.col("source_size")).cast("double")).alias("target"))


def mix_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies``."""
    docs = sized(docs)
    targets = source_targets(docs)
    rows, chars = targets.agg(F.count("*"), F.sum(F.length("source"))).first()
    if rows <= BROADCAST_ROWS and (chars or 0) <= BROADCAST_CHARS:
        targets = F.broadcast(targets)
    own, theirs = docs.alias("d"), targets.withColumnRenamed("source", "of").alias("t")
    met = own.join(theirs, F.col("d.source").eqNullSafe(F.col("t.of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return met.withColumn("copies", (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("int"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of ``docs``, one row a copy."""
    packed = docs.select("doc_id", "text", "source", F.struct("*").alias("row"))
    return mix_counts(packed).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("row.*")


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_counts(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS of_text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM totals),
filling AS (
  SELECT *, 2 * source_size / w AS stop,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         sum(source_size) OVER () AS whole,
         row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS place
  FROM weighed),
leveled AS (SELECT *, CAST(3 * whole / 2 - below AS DOUBLE) / open_w AS level FROM filling),
one AS (SELECT arg_min(level, place) FILTER (WHERE level <= stop) AS level FROM leveled),
targets AS (SELECT l.source, l.source_size, least(l.w * one.level, CAST(2 * l.source_size AS DOUBLE)) AS target FROM leveled l, one),
drawn AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('mix-2:' || coalesce(CAST(s.doc_id AS VARCHAR), '') || ':' || s.of_text), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn
"""
