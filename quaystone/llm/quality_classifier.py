"""Quality classifier: a factorisation machine.

Features are hashed words, structure statistics of the whole text in fixed
bins, and the document's declared length. The score is the logistic of bias,
linear terms and all pairwise interactions <v_i, v_j> x_i x_j, the latter by
half the difference of squared sums and sums of squares, so it is linear in
the number of features of a document.

It is fitted by AdaGrad on at most SAMPLE labelled rows, chosen by hash, whose
features (never texts) come to the driver; every document is scored where it
is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import textscan
from quaystone.llm.shared import bounded_batches
from quaystone.session import table

#: Labelled rows to fit on.
SAMPLE = 10_000
BITS = 14
RANK = 8
EPOCHS = 8
RATE = 0.08
DECAY = 1e-5
SEED = 5


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[list(chars)] = True
    return m


_KINDS = {
    "symbols": _mask(b"#*$%&|<>@~^_{}[]\\"),
    "marks": _mask(b"!?"),
    "stops": _mask(b".,;:"),
    "capitals": _mask(bytes(range(65, 91))),
    "digits": _mask(b"0123456789"),
    "lines": _mask(b"\n"),
    "beyond": _mask(bytes(range(128, 256))),
}
# Upper edges of the bins of each statistic.
_EDGES = {
    "symbols": (0.0005, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1),
    "marks": (0.0005, 0.002, 0.005, 0.01, 0.03, 0.1),
    "stops": (0.001, 0.005, 0.01, 0.02, 0.03, 0.06),
    "capitals": (0.005, 0.01, 0.02, 0.04, 0.1, 0.3, 0.6),
    "digits": (0.0005, 0.002, 0.01, 0.05, 0.2),
    "lines": (0.0005, 0.002, 0.005, 0.01, 0.03),
    "beyond": (0.001, 0.01, 0.03, 0.06, 0.1),
    "words": (1, 5, 10, 20, 40, 80, 160, 320, 1000, 4000),
    "word_bytes": (2.5, 3.5, 4.5, 5.5, 6.5, 8.0, 12.0),
    "distinct": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "declared": (1, 50, 200, 500, 1000, 2000, 5000, 20000),
}
_FIRST = dict(zip(_EDGES, np.cumsum([1 << BITS, *[len(x) + 1 for x in _EDGES.values()]])[:-1].tolist(), strict=True))
SIZE = (1 << BITS) + sum(len(x) + 1 for x in _EDGES.values())
_STAT = 0.35


def features(texts: pa.Array, declared: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk: its first row, each row's number of features, their
    indices and values. Word values are log counts of length one together."""
    for c in textscan.chunks(texts):
        s, e, first = c.words()
        n = np.diff(first)
        rows = np.repeat(np.arange(c.n, dtype=np.int64), n)
        key, count = np.unique(rows << BITS | (c.word_hashes(s, e) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        row, index, value = key >> BITS, key & ((1 << BITS) - 1), np.log1p(count)
        norm = np.sqrt(np.bincount(row, value * value, c.n))
        size = np.maximum(1, np.diff(c.offsets))
        stats = {}
        for name, mask in _KINDS.items():
            run = np.append(0, np.cumsum(mask[c.data], dtype=np.int64))
            stats[name] = np.diff(run[c.offsets]) / size
        stats["words"] = n
        stats["word_bytes"] = np.bincount(rows, e - s, c.n) / np.maximum(1, n)
        stats["distinct"] = np.bincount(row, minlength=c.n) / np.maximum(1, n)
        stats["declared"] = declared[c.first : c.first + c.n]
        stat_index = np.stack([_FIRST[k] + np.searchsorted(_EDGES[k], stats[k], "left") for k in _EDGES], 1)
        every = np.concatenate([row, np.repeat(np.arange(c.n), len(_EDGES))])
        order = np.argsort(every, kind="stable")
        yield (
            c.first,
            np.bincount(every, minlength=c.n),
            np.concatenate([index, stat_index.ravel()])[order].astype(np.int32),
            np.concatenate([value / norm[row], np.full(stat_index.size, _STAT)])[order].astype(np.float32),
        )


class Machine:
    def __init__(self, bias: float):
        rng = np.random.default_rng(SEED)
        self.bias = bias
        self.w = np.zeros(SIZE, np.float32)
        self.v = rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32)

    def raw(self, n: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score before the logistic, and the rows' summed factors. Every
        row has features: its statistics."""
        start = np.append(0, np.cumsum(n)[:-1])
        vx = self.v[index] * value[:, None]
        total = np.add.reduceat(vx, start)
        pairs = 0.5 * (total**2 - np.add.reduceat(vx**2, start)).sum(1)
        return self.bias + np.add.reduceat(self.w[index] * value, start) + pairs, total

    def score(self, n: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(n, index, value)[0].astype(np.float64), -30, 30)))

    def fit(self, n: np.ndarray, index: np.ndarray, value: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        start = np.append(0, np.cumsum(n))
        past_w, past_v, past_b = np.full(SIZE, 1e-3, np.float32), np.full((SIZE, RANK), 1e-3, np.float32), 1e-3
        for _ in range(EPOCHS):
            order = rng.permutation(len(n))
            for at in range(0, len(order), 128):
                rows = order[at : at + 128]
                m = n[rows]
                take = np.arange(m.sum()) + np.repeat(start[rows] - np.cumsum(m) + m, m)
                i, x = index[take], value[take]
                raw, total = self.raw(m, i, x)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]).astype(np.float32)
                of = np.repeat(np.arange(len(rows)), m)
                ex = error[of] * x
                used, which = np.unique(i, return_inverse=True)
                which = which.ravel()
                gv = ex[:, None] * (total[of] - self.v[i] * x[:, None])
                g = np.bincount(which, ex, len(used)) + DECAY * self.w[used]
                by = np.argsort(which, kind="stable")
                gv = np.add.reduceat(gv[by], np.searchsorted(which[by], np.arange(len(used)))) + DECAY * self.v[used]
                past_w[used] += g * g
                past_v[used] += gv * gv
                self.w[used] -= RATE * g / np.sqrt(past_w[used])
                self.v[used] -= RATE * gv / np.sqrt(past_v[used])
                b = float(error.sum())
                past_b += b * b
                self.bias -= RATE * b / np.sqrt(past_b)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch["y"].to_numpy(zero_copy_only=False)
        for first, n, index, value in features(batch["text"], batch["declared"].to_numpy(zero_copy_only=False)):
            end = np.append(0, np.cumsum(n)).astype(np.int32)
            yield pa.record_batch(
                [pa.array(y[first : first + len(n)].astype(np.float64)), pa.ListArray.from_arrays(pa.array(end), pa.array(index)), pa.ListArray.from_arrays(pa.array(end), pa.array(value))], ["y", "index", "value"]
            )


def fit(docs: DataFrame, labels: DataFrame, learns: Column) -> Machine:
    """A machine for labels (doc_id, quality) of the rows for which learns, a
    condition on doc_id, holds. Contradictory labels count by their majority."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & learns)
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    n = known.count()
    # by hash: about SAMPLE ids of any larger number; of an id's rows one, so that repeated ids do not add to them
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / max(1, n))))
    rows = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "y").agg(F.min_by(F.struct("text", "declared"), F.xxhash64("text", "declared")).alias("row"))
    rows = rows.select("y", "row.*").mapInArrow(_sampled, "y double, index array<int>, value array<float>").toArrow()
    y = rows["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        machine = Machine(0.0 if not len(y) else 5.0 if y[0] else -5.0)
        machine.v[:] = 0
        return machine
    index, value = rows["index"].combine_chunks(), rows["value"].combine_chunks()
    machine = Machine(float(np.log(y.mean() / (1 - y.mean()))))
    machine.fit(pc.list_value_length(index).to_numpy().astype(np.int64), index.flatten().to_numpy(), value.flatten().to_numpy(), y)
    return machine


def _udf(sent):
    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array, declared: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        for first, n, index, value in features(texts, declared.to_numpy(zero_copy_only=False)):
            out[first : first + len(n)] = sent.value.score(n, index, value)
        return pa.array(out)

    return score


def classify(docs: DataFrame, labels: DataFrame, learns: Column) -> DataFrame:
    """docs with score, from 0 to 1, higher for likelier quality 1.

    A null text counts as empty and is scored by its statistics, a null or
    missing n_chars as -1; a text of any length is scored whole. Without labels
    all scores are 0.5, with labels of one class near that class. Repeated rows
    are scored each, and a repeated id is learned from once; an empty table
    gives an empty result; a column of docs named score is replaced.
    """
    bounded_batches(docs.sparkSession)
    declared = F.coalesce(F.col("n_chars").cast("double"), F.lit(-1.0)) if "n_chars" in docs.columns else F.lit(-1.0)
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", text.alias("text"), declared.alias("declared"))
    sent = docs.sparkSession.sparkContext.broadcast(fit(slim, labels, learns))
    return docs.withColumn("score", _udf(sent)(text, declared))


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, by modulus; -1 for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = classify(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
