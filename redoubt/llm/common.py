"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle as checkpoint
from ..session import shared_dir

__all__ = ["BLANKS", "checkpoint", "connected_components", "dealt_anew", "partitions", "shared_dir", "table"]

#: White space of the operator contracts, as bytes: space and U+0009 to U+000D.
BLANKS = b" \t\n\x0b\x0c\r"

EDGES = 1 << 14  # edges to a file between the rounds of ``connected_components``


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_anew(column: str) -> Column:
    """A long key whose earlier partitioning the planner doesn't know: a join on
    it shuffles both sides, so a key's many rows can be split among tasks."""
    return F.col(column).bitwiseXOR(F.lit(0).cast("long"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(u, v)``; the
    root is the smallest node of its component.

    Alternates the large-star and small-star steps: every node points its
    larger (then its smaller) neighbours at the smallest one.  Each step is a
    minimum per node joined back to the edges, so no neighbour list is ever
    gathered in one task and a hub's edges may be split by the skew join.
    Edges are written to the shared folder after every round, in as many files
    as their counted number needs: few edges in many files cost more than the step.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew("u").alias("c"), F.least("u", "m").alias("m"))
        met = both.join(least, both.u == least.c)
        if large:
            out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                least.where("c <> m").select(F.col("c").alias("u"), F.col("m").alias("v"))
            )
        return out.where("u <> v").distinct()

    def seal(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = seal(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        now = checkpoint(star(star(now, True), False).coalesce(-(-mark[0] // EDGES)))
        mark, before = seal(now), mark
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
