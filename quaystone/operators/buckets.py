"""Tables on disk whose rows are replaced by key, a few buckets at a time.

A table is a folder. Rows lie in buckets by a hash of their keys; a change reads
and rewrites the buckets that hold fresh keys, under a new version, and leaves
all other files as they are. A manifest, a few bytes a bucket, names the version
of each bucket; it is written last, so a change that dies before is none, and
readers of an older manifest keep their files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

_MANIFEST = "bucket int, held long, version long"


class Buckets:
    """The table at path, of a schema, dealt by keys into so many buckets. One
    writer at a time."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _manifest(self) -> dict[int, int]:
        """The version of each bucket that has rows: at most as many as there are buckets."""
        try:
            every = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException:
            return {}
        newest = every.agg(F.max("version")).first()[0]
        rows = every.where(F.col("version") == newest).select("bucket", "held").limit(self.buckets + 1).collect()
        return {r["bucket"]: r["held"] for r in rows if r["bucket"] is not None} | {None: newest}

    def _files(self, held: dict, wanted: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in held.items() if b is not None and (wanted is None or b in wanted)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def read(self) -> DataFrame:
        """The rows of the newest version."""
        return self._files(self._manifest())

    def changed(self, fresh: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Replaces the rows of the buckets that fresh has keys of by
        merge(those rows, fresh). Gives how many buckets were rewritten."""
        held = self._manifest()
        wanted = [r[0] for r in self._bucketed(fresh.select(*self.keys)).select("_bucket").distinct().collect()]
        if not wanted:
            return 0
        version = (held.get(None) or 0) + 1
        columns = self.spark.createDataFrame([], self.schema).columns
        merged = self._bucketed(merge(self._files(held, wanted), fresh).select(*columns))
        at = f"{self.path}/rows/version={version}"
        merged.repartition(len(wanted), "_bucket").withColumnRenamed("_bucket", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        # buckets that the change left without rows have no folder
        full = self.spark.read.schema(f"{self.schema}, bucket int").parquet(at).select("bucket").distinct().collect()
        kept = {b: v for b, v in held.items() if b is not None and b not in wanted} | {r[0]: version for r in full}
        rows = [(b, v, version) for b, v in kept.items()] + [(None, None, version)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return len(wanted)

    def upsert(self, fresh: DataFrame, at: str) -> int:
        """fresh rows in place of those of their keys; of several of a key the
        latest by at, of equally late ones the greatest."""
        columns = [c for c in fresh.columns if c not in self.keys]
        order = F.struct(at, *[c for c in columns if c != at])
        last = fresh.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*self.keys, "r.*")
        return self.changed(last, lambda stored, new: stored.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new))

    def replace(self, fresh: DataFrame) -> int:
        """All rows of the keys that fresh has, replaced by fresh: for keys
        with many rows, such as a source and its chunks."""
        return self.changed(fresh, lambda stored, new: stored.join(new.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(new))

    def append(self, fresh: DataFrame) -> int:
        """fresh beside what is there."""
        return self.changed(fresh, lambda stored, new: stored.unionByName(new))
