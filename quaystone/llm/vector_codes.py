"""Product codes of vectors, with pivots that prune the codebook search.

A vector is cut into parts; each part position has a codebook that starts from
the parts of the smallest ids and is refined twice. Before the rounds, every
part's distance to a few fixed pivots is computed once and kept beside it.
Each round knows the pivots' distances to its entries, and the difference of
the two is a lower bound of a part's distance to an entry: entries are taken in
the order of that bound, evaluated exactly in integers, and dropped as soon as
the bound exceeds the best found. Bounds are doubles with a margin that covers
their rounding, so no entry that could be nearest, or tie, is lost.

The table of parts is scanned once a round; what leaves the executors are sums
by part, entry and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.shared import bounded_batches, small, written
from quaystone.llm.vectors import blobs, coded, matrix, slots, summed
from quaystone.session import table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
PIVOTS = 4
#: Parts searched at a time: their bounds stay in the processor's caches.
CHUNK = 2048
#: Relative rounding of a stored (single precision) distance, with room to spare.
ROUNDING = 1e-6


def pivots_of(book: np.ndarray, m: int = PIVOTS) -> np.ndarray:
    """m entries of a codebook far from each other: the first, then always the
    one farthest from those taken."""
    d = ((book[:, None] - book[None]) ** 2).sum(axis=2)
    taken = [0]
    while len(taken) < min(m, len(book)):
        taken.append(int(d[taken].min(axis=0).argmax()))
    return book[taken]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each row of x to each of y."""
    return np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2).astype(float))


def nearest(x: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Entry and squared distance of each part, the lower entry on a tie, and
    how many distances were evaluated."""
    known = distances(pivots, book)
    margin = ROUNDING * (to_pivots.max(initial=0) + known.max(initial=0)) + 1e-9
    bound = np.zeros((len(x), len(book)))
    for j in range(len(pivots)):
        np.maximum(bound, np.abs(to_pivots[:, j, None] - known[j]), out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1) - margin
    best, entry, active, evaluated = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64), np.arange(len(x)), 0
    for t in range(len(book)):
        if t:
            active = active[bound[active, t] <= np.sqrt(best[active].astype(float)) * (1 + 1e-12)]
        if not len(active):
            break
        e = order[active, t]
        step = x[active] - book[e]
        d = (step * step).sum(axis=1)
        won = (d < best[active]) | ((d == best[active]) & (e < entry[active]))
        best[active[won]], entry[active[won]] = d[won], e[won]
        evaluated += len(active)
    return entry, best, evaluated


class Codec:
    """books: part position x entry x component; pivots likewise, fixed."""

    def __init__(self, books: np.ndarray, pivots: np.ndarray):
        self.books, self.pivots = books, pivots

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, part position, parts, distances to pivots) by chunks."""
        p, _, w = self.books.shape
        x = matrix(batch["code"], "<i4", p * w).reshape(-1, p, w).astype(np.int64)
        held = matrix(batch["pivots"], "<f4", p * self.pivots.shape[1]).reshape(len(x), p, -1).astype(float)
        for at in range(0, len(x), CHUNK):
            for i in range(p):
                yield at, i, x[at : at + CHUNK, i], held[at : at + CHUNK, i]

    def searched(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        for at, i, x, held in self.parts(batch):
            entry, d, _ = nearest(x, held, self.books[i], self.pivots[i])
            yield at, i, x, entry, d


def _measured(pivots: np.ndarray):
    """Appends each part's distances to its pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, m, w = pivots.shape
        for batch in batches:
            x = matrix(batch["code"], "<i4", p * w).reshape(-1, p, w).astype(np.int64)
            held = np.stack([distances(x[:, i], pivots[i]) for i in range(p)], axis=1).astype("<f4")
            yield pa.record_batch([batch["id"], batch["kept"], batch["code"], blobs(held.reshape(len(x), p * m))], ["id", "kept", "code", "pivots"])

    return run


def _sums(codec: Codec):
    """Sums of components, then members, by part position and entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, k, w = codec.books.shape
        out = np.zeros((p, k, w + 1), np.int64)
        for batch in batches:
            for _, i, x, entry, _ in codec.searched(batch):
                np.add.at(out[i, :, :w], entry, x)
                out[i, :, w] += np.bincount(entry, minlength=k)
        yield slots(out)

    return run


def _encoded(codec: Codec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros((len(batch), len(codec.books)), np.uint8), np.zeros(len(batch), np.int64)
            for at, i, x, entry, d in codec.searched(batch):
                code[at : at + len(x), i] = entry
                error[at : at + len(x)] += d
            yield pa.record_batch([batch["id"], batch["kept"], blobs(code), pa.array(error)], ["id", "kept", "code", "error"])

    return run


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vector: str = "embedding", name: str = "vec_id", keep: tuple[str, ...] = ("label",)) -> tuple[DataFrame, np.ndarray]:
    """(id, keep's columns, code: an entry a byte, error) of every vector
    without null or non-finite component, written, and the final codebooks.

    The usual length is that of most vectors (of equally many the larger) that
    parts divides; vectors of another length stay, with null code and error.
    At most 256 entries. Equal distances go to the lower entry. Of rows that
    share an id, those of smaller code bytes start first; rows are taken one by
    one, so repeated ones count as often as they come. Null ids start no entry;
    with fewer ids than entries the codebooks are shorter, and vectors without
    any id are an error. A table without a vector to keep gives an empty
    result. Columns that are not named are ignored, and no name of a kept one
    is taken inside.
    A component too large for exact long distances is an error.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(name).cast("long").alias("id"), F.struct(F.lit(0).alias("_"), *keep).alias("kept"), F.col(vector).alias("vector"))
    codes = written(coded(rows, "vector", scale, ["id", "kept"]), "codes")
    lengths = codes.where(f"n > 0 and n % {parts} = 0").groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    out = ["id", *[F.col(f"kept.{c}").alias(c) for c in keep], "code", "error"]
    odd = codes.withColumns({"code": F.lit(None).cast("binary"), "error": F.lit(None).cast("long")})
    if not lengths:
        return odd.select(out), np.zeros((parts, 0, 0), np.int64)
    w = lengths["n"] // parts
    usual = codes.where(F.col("n") == lengths["n"])
    first = usual.where("id is not null").select("id", "code").orderBy("id", "code").limit(entries).collect()
    if not first:
        raise ValueError("no vector has an id: there is nothing to start from")
    books = np.array([np.frombuffer(r["code"], "<i4") for r in first], np.int64).reshape(len(first), parts, w).transpose(1, 0, 2)
    pivots = np.stack([pivots_of(b) for b in books])
    columns = f"id long, kept {codes.schema['kept'].dataType.simpleString()}"
    measured = written(usual.mapInArrow(_measured(pivots), f"{columns}, code binary, pivots binary"), "parts")
    for _ in range(rounds):
        total = summed(measured.mapInArrow(_sums(Codec(books, pivots)), "slot long, total long"), (*books.shape[:2], w + 1))
        members = total[..., -1:]
        books = np.where(members > 0, total[..., :-1] // np.maximum(members, 1), books).astype(np.int64)
    done = measured.mapInArrow(_encoded(Codec(books, pivots)), f"{columns}, code binary, error long")
    rest = odd.where(F.col("n") != lengths["n"])
    return written(done.select(out).union(rest.select(out)), "coded"), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12 over all embeddings."""
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    by_label = written(rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label_errors")
    joined = rows.join(small(by_label), F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(rounds: int) -> str:
    """The same in SQL: every round assigns by all distances."""
    floor = "CASE WHEN s >= 0 THEN s // k ELSE -((-s + k - 1) // k) END"
    ctes = [
        "kept AS (SELECT row_number() OVER () AS r, vec_id, label, embedding, len(embedding) // 16 AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))",
        f"v AS (SELECT r, (i - 1) // w AS p, (i - 1) % w AS j, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, w, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept))",
        f"first AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY e LIMIT {ENTRIES})",
        "b0 AS (SELECT p, e, j, x FROM first JOIN v USING (r))",
    ]
    for n in range(rounds + 1):
        ctes.append(f"d{n} AS (SELECT r, p, e, CAST(sum((v.x - b{n}.x) * (v.x - b{n}.x)) AS BIGINT) AS d FROM v JOIN b{n} USING (p, j) GROUP BY ALL)")
        ctes.append(f"a{n} AS (SELECT r, p, min(d) AS d, min(e) AS e FROM d{n} JOIN (SELECT r, p, min(d) AS d FROM d{n} GROUP BY ALL) USING (r, p, d) GROUP BY r, p)")
        if n < rounds:
            ctes.append(f"m{n} AS (SELECT p, e, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS k FROM a{n} JOIN v USING (r, p) GROUP BY ALL)")
            ctes.append(f"b{n + 1} AS (SELECT p, e, j, coalesce({floor}, x) AS x FROM b{n} LEFT JOIN m{n} USING (p, e, j))")
    ctes.append(f"o AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)")
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256 FROM kept JOIN o USING (r)"""
    )


ORACLE = _oracle(ROUNDS)
