"""Structured Streaming forms: detection of single documents, and windowed counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import detect as D
from ..session import shared_dir
from ..sources import text as T


def findings(docs: DataFrame, rules: list[R.Rule] | None = None) -> DataFrame:
    """Pattern findings of a stream of documents: stateless, a document is whole in its row."""
    return D.patterns(T.paragraphs(docs), rules)


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def event_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by tumbling window and type; state older than the watermark goes."""
    timed = _timed(events, late).groupBy(F.window("ts", size), "event_type")
    return timed.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Event counts by user session: a gap closes a session."""
    timed = _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return timed.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into files of the shared folder, and read them; ``complete`` and ``update`` keep the last batch's rows."""
    spark: SparkSession = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    query = writer.foreachBatch(lambda df, n: df.write.mode("append" if mode == "append" else "overwrite").parquet(f"{base}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over parquet files, a folder or one file, with the schema they have now."""
    now = spark.read.parquet(path)
    files, folder, name = now.inputFiles(), *path.rstrip("/").rpartition("/")[::2]
    alone = len(files) == 1 and files[0].rstrip("/").endswith("/" + name)
    reader = spark.readStream.schema(now.schema)
    return reader.option("pathGlobFilter", name).parquet(folder) if alone else reader.parquet(path)
