"""Session settings shared by the benchmark, the tests and interactive use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the engine expects of any session.

    On a cluster these come from spark-defaults; nothing in the engine depends
    on a particular number of cores or partitions.
    """
    n = shuffle_partitions or (8 if cores == "*" else max(8, int(cores)))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quaystone")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.python.filterPushdown.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", os.environ.get("QUAYSTONE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a file or a directory of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_methods(spark: SparkSession) -> None:
    """Has Spark generate the projections of rows of over 20 fields one by one,
    in short methods. In one method for them all, which is its default up to
    100 fields, long projections go beyond what the JVM compiles. An option of
    the caller's session; a lower number there is kept."""
    name = "spark.sql.codegen.maxFields"
    if int(spark.conf.get(name)) > 20:
        spark.conf.set(name, "20")


def small_batches(spark: SparkSession) -> None:
    """Limits what a Python worker takes at once to 1,000 rows and 4 MB, however
    large its partition is. Two options of the caller's session; a lower number
    of rows there is kept."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= 1000:
        spark.conf.set(rows, "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def shared_folder(spark: SparkSession, name: str) -> str:
    """The name of a new folder that every executor sees, below
    spark.checkpoint.dir. Only a local session without the setting, as in
    tests, gets a temporary one; a cluster must name a folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quaystone-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a shared folder and read back: for what is dear to make
    and used more than once. Lineage ends there, so a lost executor costs
    nothing that was written."""
    at = shared_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
