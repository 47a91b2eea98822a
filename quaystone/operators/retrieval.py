"""Vector retrieval, chunking and content-keyed upserts."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions.chunking import chunks
from quaystone.functions.documents import content_hash
from quaystone.session import shared_folder

#: Query vectors of a block, and blocks that a worker keeps.
QUERY_BLOCK = 4096
BLOCKS_KEPT = 4


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def match(vectors: DataFrame, queries: DataFrame, threshold: float, k: int) -> DataFrame:
    """query_id, vec_id, similarity, rank: for each query (query_id, embedding)
    the k nearest of vectors (vec_id, embedding) above threshold, ties by id.
    Vectors of another length than the query, or of none, are near to nothing.

    The queries are written in blocks to the shared folder, and the vectors are
    scanned once: a batch of vectors by a block of queries is one matrix
    product, of which at most k rows a query go on to the final ranking."""
    spark = vectors.sparkSession
    folder = shared_folder(spark, "queries")
    held = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("size(embedding) > 0")
    held.write.parquet(f"{folder}/all")
    held = spark.read.parquet(f"{folder}/all")
    n_blocks = -(-held.count() // QUERY_BLOCK)
    if n_blocks:
        held.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")).repartition(n_blocks, "block").write.partitionBy("block").parquet(f"{folder}/blocks")
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("size(embedding) > 0").mapInArrow(_nearest(folder, n_blocks, threshold, k), _FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_FOUND = "query_id long, vec_id long, similarity double"
_held: OrderedDict = OrderedDict()


def _unit(rows: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the places of the vectors of that length, and their unit vectors."""
    n = pc.list_value_length(rows).to_numpy()
    flat, end = pc.list_flatten(rows).to_numpy(), np.cumsum(n)
    out = {}
    for size in np.unique(n):
        at = np.flatnonzero(n == size)
        x = flat[(end[at] - size)[:, None] + np.arange(size)]
        out[int(size)] = at, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return out


def _queries(folder: str, i: int):
    """A block of queries, kept while it is among the last few used."""
    if (folder, i) not in _held:
        while len(_held) >= BLOCKS_KEPT:
            _held.popitem(last=False)
        fs, root = pafs.FileSystem.from_uri(folder)
        at = f"{root}/blocks/block={i}"
        t = pads.dataset(at, filesystem=fs, format="parquet").to_table(columns=["query_id", "embedding"]) if fs.get_file_info(at).type else None
        _held[folder, i] = {} if t is None or not t.num_rows else {size: (t["query_id"].to_numpy()[rows], x) for size, (rows, x) in _unit(t["embedding"].combine_chunks()).items()}
    _held.move_to_end((folder, i))
    return _held[folder, i]


def _nearest(folder: str, n_blocks: int, threshold: float, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch["vec_id"].to_numpy(zero_copy_only=False)
            units = _unit(batch["embedding"])
            for b in range(n_blocks):
                for size, (ids, q) in _queries(folder, b).items():
                    if size not in units:
                        continue
                    rows, x = units[size]
                    for at in range(0, len(rows), 2048):
                        # rounded, so that the order of a sum never decides a rank
                        s = np.round(x[at : at + 2048] @ q.T, 9)
                        near = s > threshold
                        if len(s) > k:  # the k-th best of each query; its ties are ranked below
                            near &= s >= -np.partition(-s, k - 1, axis=0)[k - 1]
                        i, j = np.nonzero(near)
                        order = np.lexsort((vec[rows[at + i]], -s[i, j], j))
                        i, j = i[order], j[order]
                        keep = np.arange(len(j)) - np.searchsorted(j, j) < k
                        i, j = i[keep], j[keep]
                        yield pa.record_batch([pa.array(ids[j]), pa.array(vec[rows[at + i]]), pa.array(s[i, j])], ["query_id", "vec_id", "similarity"])

    return run


def indexed_chunks(texts: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """texts (source, text) as source, chunk_index, content: a row a chunk."""
    return texts.select("source", F.posexplode(chunks(F.col("text"), size, overlap)).alias("chunk_index", "content"))


def with_hash(chunked: DataFrame) -> DataFrame:
    return chunked.withColumn("content_hash", content_hash(F.col("source"), F.col("content")))


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored after fresh (source, content, content_hash): rows of a fresh
    source whose hash is gone are dropped, new hashes added, others kept."""
    fresh = fresh.dropDuplicates(["content_hash"])
    sources = fresh.select("source").distinct()
    stale = stored.join(sources, "source", "left_semi").join(fresh.select("content_hash"), "content_hash", "left_anti").select("content_hash")
    kept = stored.join(stale, "content_hash", "left_anti").select(stored.columns)
    return kept.unionByName(fresh.join(kept.select("content_hash"), "content_hash", "left_anti").select(stored.columns))


def keep_first(rows: DataFrame, key: str, id_column: str) -> DataFrame:
    """One row a key, that of the smallest id, by one aggregation."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), id_column).alias("r")).select(key, "r.*")


