"""Spark-side helpers of the corpus operators: cutting lineage, size-checked
broadcasts, shuffle width, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a side of a join is broadcast after both were
#: counted; a shuffle join is used beyond either.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20
#: The largest Arrow batch sent to a Python worker.
BATCH_ROWS = 1_000
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. Only a local session without the
    setting, as in tests, gets a temporary one; a cluster must name a folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="quaystone-")
    spark.sparkContext.setCheckpointDir(at)
    return at


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage is cut, and a
    lost executor costs nothing that was already written."""
    at = new_folder(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bounded_batches(spark: SparkSession) -> None:
    """Limits the Arrow batches of whole texts that go to Python: by default a
    batch is 10,000 rows, which long texts make hundreds of megabytes."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    spark.conf.set(size, str(BATCH_BYTES))


def width(spark: SparkSession, units: int = 0, a_part: int = 1) -> int:
    """Shuffle partitions: the session's number, or more where units, a count
    of what is shuffled, would make a partition hold more than a_part."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-units // a_part))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows and bytes allow it, else as
    it is. df should be cheap to count, for instance already written."""
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    each = F.lit(8 * len(df.columns)).cast("long")
    for x in long:
        each = each + x
    n, total = df.agg(F.count("*"), F.sum(each)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected edge list (src, dst): component is
    the smallest node reachable. Nodes are longs; self-loops are allowed and
    are how a lone node is given.

    Each round takes the smallest label over a node's neighbours and then
    follows that label's own label (pointer jumping), so long chains shrink
    geometrically. Minima are pre-aggregated before they are shuffled, so a
    node with very many neighbours is no hot spot. Labels are written to the
    shared folder after each round.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    both = written(both, "edges")
    label = written(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = (
            both.join(label.select(F.col("node").alias("src"), "component"), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        stepped = label.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = label.select(F.col("node").alias("next"), F.col("component").alias("further"))
        label_next = written(
            stepped.join(jump, "next", "left").select(
                "node", F.least("next", F.coalesce("further", "next")).alias("component"), F.col("component").alias("was")
            ),
            "labels",
        )
        changed = label_next.where("component <> was").limit(1).count()
        label = label_next.select("node", "component")
        if not changed:
            return label
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
