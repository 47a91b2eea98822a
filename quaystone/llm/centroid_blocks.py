"""Centroid clustering over blocks in Hilbert order, exact in integers.

Vectors become integers once. They are sorted along a Hilbert curve through
all their components, those of the largest variance first, and cut into blocks
of neighbours that carry the least and the largest value of each component (a
zone map). In every round a block's box decides which centroids can be nearest
to any vector in it: a centroid goes if its least distance to the box exceeds
another's largest, or if the difference of both distances, which is linear, is
positive all over the box. Only what is left is compared, vectorised and exactly.

A block is at most BLOCK rows and ranges are cut by (curve, row number), so
equal vectors are spread over as many partitions as they need. What leaves the
executors are sums by centroid and component, never vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.shared import bounded_batches, width, written
from quaystone.llm.vectors import blobs, coded, matrix, slots, summed
from quaystone.session import table

DIMS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
#: Vectors of a block.
BLOCK = 256
#: Vectors of a partition of the one shuffle.
A_PART = 200_000
#: Bits a component has in the curve: below or above its mean, near or far.
BITS = 2


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells (numbers below
    2**bits), as bytes that sort in curve order.

    The axes are turned to transposed curve coordinates from the highest bit
    down: where an axis has the bit, the lower bits of the first axis are
    inverted, else those of both are exchanged; Gray decoding follows.
    """
    x = cells.astype(np.uint8).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        high, low = np.uint8(1 << b), np.uint8((1 << b) - 1)
        for i in range(n):
            has = (x[i] & high) > 0
            swap = np.where(has, 0, (x[0] ^ x[i]) & low).astype(np.uint8)
            x[0] ^= np.where(has, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint8)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.uint8(1 << b), np.uint8((1 << b) - 1), np.uint8(0))
    x ^= turn
    planes = [(x >> np.uint8(b)) & np.uint8(1) for b in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T, axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a vector between low
    and high. Integers, so equal distances stay equal and none of a tie goes."""
    away = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    far = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    kept = np.flatnonzero((away * away).sum(axis=1) <= (far * far).sum(axis=1).min())
    c = centroids[kept]
    norm = (c * c).sum(axis=1)
    step = c[:, None, :] - c[None, :, :]
    # the least of d(x, a) - d(x, b) in the box; above zero, b beats a everywhere
    least = norm[:, None] - norm[None, :] - 2 * np.maximum(step * low, step * high).sum(axis=2)
    return kept[~(least > 0).any(axis=1)]


def nearest(x: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest of some centroids, the
    smaller number on a tie. Doubles hold the sums exactly as long as
    components stay below 2**22; beyond, long integers do."""
    c = centroids[among]
    kind = np.float64 if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < 1 << 22 else np.int64
    a, b = x.astype(kind), c.astype(kind)
    d = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    best = d.argmin(axis=1)
    return among[best], d[np.arange(len(x)), best].astype(np.int64)


def _keys(order: np.ndarray, mean: np.ndarray, spread: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = (matrix(batch["code"], "<i4", len(order))[:, order] - mean[order]) / spread[order]
            cells = 2 * (z >= 0) + ((np.abs(z) >= 0.6745) ^ (z < 0))  # quarters of a bell curve, in order
            yield batch.append_column("key", blobs(hilbert_keys(cells, BITS)))

    return run


def _moments(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((2, dims))
        for batch in batches:
            x = matrix(batch["code"], "<i4", dims).astype(float)
            out += [x.sum(axis=0), (x * x).sum(axis=0)]
        yield slots(out)

    return run


def _blocks(dims: int, size: int):
    """Sorted rows to rows (ids, codes, low, high), a block each."""

    def block(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        cut = [x.reshape(1, -1), x.min(axis=0)[None], x.max(axis=0)[None]]
        return pa.record_batch([lists, *[blobs(y) for y in cut]], ["ids", "codes", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = pa.array([], pa.int64()), np.zeros((0, dims), "<i4")
        for batch in batches:
            ids, x = pa.concat_arrays([ids, batch["id"]]), np.concatenate([x, matrix(batch["code"], "<i4", dims)])
            cut = len(x) - len(x) % size
            for at in range(0, cut, size):
                yield block(ids[at : at + size], x[at : at + size])
            ids, x = pa.concat_arrays([ids[cut:]]), x[cut:].copy()
        if len(x):
            yield block(ids, x)

    return run


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, int]]:
    """ids, vectors, cluster, distance and number of candidates of each block."""
    dims = centroids.shape[1]
    low, high = (matrix(batch[c], "<i4", dims).astype(np.int64) for c in ("low", "high"))
    for i in range(len(batch)):
        x = np.frombuffer(batch["codes"][i].as_buffer(), "<i4").reshape(-1, dims).astype(np.int64)
        among = candidates(low[i], high[i], centroids)
        yield (batch["ids"][i].values, x, *nearest(x, centroids, among), len(among))


def _sums(centroids: np.ndarray):
    """Sums of components, then members, by centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = centroids.shape
        out = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for _, x, cluster, _, _ in _assigned(batch, centroids):
                order = np.argsort(cluster, kind="stable")
                found, start = np.unique(cluster[order], return_index=True)
                out[found, :dims] += np.add.reduceat(x[order], start, axis=0)
                out[:, dims] += np.bincount(cluster, minlength=k)
        yield slots(out)

    return run


def _final(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, cluster, distance, among in _assigned(batch, centroids):
                yield pa.record_batch([ids, pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(np.full(len(ids), among, np.int32))], ["id", "cluster", "distance", "candidates"])

    return run


def zone_maps(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, vector: str = "embedding", name: str = "vec_id") -> tuple[DataFrame, DataFrame]:
    """(codes, blocks): the kept vectors as integers (id, n, code), and in
    blocks of Hilbert order (ids, codes, low, high), both written."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    codes = written(coded(vectors.select(F.col(name).cast("long").alias("id"), F.col(vector).alias("vector")), "vector", scale, ["id"], dims), "codes")
    n = codes.count()
    total = summed(codes.mapInArrow(_moments(dims), "slot long, total double"), (2, dims), float)
    mean = total[0] / max(n, 1)
    variance = np.maximum(total[1] / max(n, 1) - mean * mean, 0)
    order = np.argsort(-variance, kind="stable")
    spread = np.sqrt(np.where(variance > 0, variance, 1))
    keyed = codes.mapInArrow(_keys(order, mean, spread), "id long, n int, code binary, key binary").withColumn("row", F.monotonically_increasing_id())
    ranges = keyed.repartitionByRange(width(spark, n, A_PART), "key", "row").sortWithinPartitions("key", "row")
    return codes, written(ranges.mapInArrow(_blocks(dims, BLOCK), "ids array<long>, codes binary, low binary, high binary"), "blocks")


def starts(codes: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The k vectors whose id has the smallest SHA-256 of "1:<id>", in that
    order; of rows that share an id, by their components. Null ids start none."""
    ranked = codes.where("id is not null").select(F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256).alias("h"), "code").orderBy("h", "code").limit(k)
    rows = ranked.collect()
    return np.array([np.frombuffer(r["code"], "<i4") for r in rows], np.int64) if rows else np.zeros((0, DIMS), np.int64)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, vector: str = "embedding", name: str = "vec_id") -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance, candidates: centroids that the row's block was
    compared with) of every kept vector, written, and the final centroids.

    A vector that is null, has a null or non-finite component or not dims of
    them is left out. Equal distances go to the smaller number. Rows are taken
    one by one: repeated ones count as often as they come, null ids are
    clustered but start no centroid. With fewer vectors than k there are fewer
    centroids; a table without a vector to keep gives an empty result; where
    every id is null there is no start, which is an error. Other columns, of
    any name, are ignored. A component too large for exact long distances
    (2**27 after scaling) is an error, not a wrong number.
    """
    codes, blocks = zone_maps(vectors, dims, scale, vector, name)
    centroids = starts(codes, k)
    if not len(centroids):
        if codes.limit(1).count():
            raise ValueError("no vector has an id: there is nothing to start from")
        return codes.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("candidates")).limit(0), centroids
    for _ in range(rounds):
        total = summed(blocks.mapInArrow(_sums(centroids), "slot long, total long"), (len(centroids), dims + 1))
        centroids = np.array([[int(s) // int(t[-1]) for s in t[:-1]] if t[-1] else list(c) for t, c in zip(total, centroids, strict=True)], np.int64)
    return written(blocks.mapInArrow(_final(centroids), "id long, cluster int, distance long, candidates int"), "clusters"), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11 over all embeddings."""
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    total = sum(sums.values())
    known = [(i, sums.get(i, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    of = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(of), "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int) -> str:
    """The same in SQL: every round assigns by all distances."""
    ctes = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})",
        f"v AS (SELECT r, vec_id, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, {DIMS + 1}) t(i))",
        f"first AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM kept ORDER BY c LIMIT {CENTROIDS})",
        "c0 AS (SELECT c, i, x FROM first JOIN v USING (r))",
    ]
    for n in range(rounds + 1):
        ctes.append(f"d{n} AS (SELECT r, vec_id, c, sum((v.x - c{n}.x) * (v.x - c{n}.x)) AS d FROM v JOIN c{n} USING (i) GROUP BY ALL)")
        ctes.append(f"a{n} AS (SELECT r, vec_id, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS k FROM d{n}) WHERE k = 1)")
        if n < rounds:
            ctes.append(f"m{n} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS k FROM a{n} JOIN v USING (r) GROUP BY c, i)")
            floor = "CASE WHEN s >= 0 THEN s // k ELSE -((-s + k - 1) // k) END"
            ctes.append(f"c{n + 1} AS (SELECT c, i, coalesce({floor}, x) AS x FROM c{n} LEFT JOIN m{n} USING (c, i))")
    ctes.append(f"h AS (SELECT c, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)")
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM a{rounds} JOIN h USING (c)"""
    )


ORACLE = _oracle(ROUNDS)
