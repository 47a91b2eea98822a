"""What the vector operators share: integer codes of vectors and sums by slot."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integer components beyond this are refused: squared distances of vectors would no longer fit a long.
LARGEST = 1 << 27


def matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """A binary column, each value width numbers of a kind, as a matrix."""
    if not len(column):
        return np.zeros((0, width), kind)
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, width)


def blobs(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)])


def coded(vectors: DataFrame, vector: str, scale: int, keep: list[str], dims: int | None = None) -> DataFrame:
    """keep's columns, n (components) and code (each component times scale,
    floored, as int32 in a binary) of the vectors that are not null, hold no
    null or non-finite component and, if dims is given, have so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["_vector"]
            n = pc.list_value_length(lists)
            kept = np.flatnonzero((pc.fill_null(pc.equal(n, dims), False) if dims else pc.is_valid(n)).to_numpy(zero_copy_only=False))
            at = n.take(pa.array(kept)).to_numpy(zero_copy_only=False).astype(np.int64)
            x = lists.take(pa.array(kept)).flatten().to_numpy(zero_copy_only=False)  # a null component is NaN here
            ends = np.append(0, np.cumsum(at))
            bad = np.append(0, np.cumsum(~np.isfinite(x)))
            whole = bad[ends[1:]] == bad[ends[:-1]]
            x = np.floor(np.where(np.isfinite(x), x, 0) * scale)
            if len(x) and np.abs(x[np.repeat(whole, at)]).max(initial=0) > LARGEST:
                raise ValueError(f"a component times {scale} is beyond {LARGEST}: its squared distances do not fit a long")
            x = np.where(np.abs(x) <= LARGEST, x, 0).astype("<i4")
            codes = [x[a:b].tobytes() for a, b, ok in zip(ends[:-1], ends[1:], whole, strict=True) if ok]
            rows = batch.take(pa.array(kept[whole]))
            yield pa.record_batch([*[rows[c] for c in keep], pa.array(at[whole], pa.int32()), pa.array(codes, pa.binary())], [*keep, "n", "code"])

    types = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "n int, code binary"])
    return vectors.select(*keep, F.col(vector).cast("array<double>").alias("_vector")).mapInArrow(run, schema)


def slots(totals: np.ndarray) -> pa.RecordBatch:
    """The nonzero numbers of an array by their place, as rows (slot, total)."""
    flat = totals.ravel()
    at = np.flatnonzero(flat)
    return pa.record_batch([pa.array(at.astype(np.int64)), pa.array(flat[at])], ["slot", "total"])


def summed(parts: DataFrame, shape: tuple[int, ...], kind: type = int) -> np.ndarray:
    """The sums by slot of rows (slot, total) as an array of Python or float
    numbers. Its size is that of the model, not of the data; a sum that does
    not fit a long is an error in Spark, never wrapped."""
    out = np.zeros(int(np.prod(shape)), object if kind is int else float)
    for slot, total in parts.groupBy("slot").agg(F.sum("total").alias("total")).collect():
        out[slot] = total
    return out.reshape(shape)
