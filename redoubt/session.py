"""Session helpers: the shared folder and tables that cut lineage there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build(cpus: int | str = "*", memory: str = "16g") -> SparkSession:
    """A local session with the settings the engine is tuned with."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    ``spark.checkpoint.dir`` names it.  Where it is unset, a local session (tests)
    gets a temporary folder and a cluster gets one below the warehouse.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if sc.master.split("[")[0] == "local":
            found = tempfile.mkdtemp(prefix="redoubt-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_redoubt"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: computed once, plans start anew there, and lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
