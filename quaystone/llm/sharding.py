"""Sharding by sampled splitters.

The key of a record is (hash of its text, doc_id), so equal texts stand next
to each other. Size-weighted samples of the keys give quantile boundaries of
coarse ranges; ranges that turn out overfull are sampled again, until each is
small enough or holds one key alone: between texts, a range of one text by
doc_id, and a range of rows that are equal in both by a number of the row. Runs
of fine ranges become shards of nearly equal bytes, and exact row counts of the
ranges give gapless slots. Each range's quantiles are taken on executors. What
reaches the driver are numbers of ranges, a boundary and three sums each, as
arrays: some 40 bytes for ROWS_A_RANGE rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm.shared import written
from quaystone.session import table

N_SHARDS = 16
RANGES_A_SHARD = 64
ROWS_A_RANGE = 200_000
SAMPLES_A_RANGE = 16
#: Ranges of the first cut, whose samples are one group.
COARSE = 4096
#: A range is overfull beyond so many times the size aimed at.
OVERFULL = 1.5
LEAST = -(2**63)


@dataclass
class Plan:
    """Boundaries (hash, doc_id), sorted; by range the number of its pieces
    and of the first; by piece its shard and its first slot."""

    hashes: np.ndarray
    ids: np.ndarray
    pieces: np.ndarray
    first_piece: np.ndarray
    shard: np.ndarray
    first_slot: np.ndarray

    def splits_rows(self) -> bool:
        return bool((self.pieces > 1).any())


def _range_of(hashes: np.ndarray, ids: np.ndarray):
    """A column of the number of boundaries at or below (hash, doc_id)."""

    @F.pandas_udf(T.IntegerType())
    def find(h: pd.Series, d: pd.Series) -> pd.Series:
        h, d = h.to_numpy(), d.to_numpy()
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        out = high.copy()
        inner = np.flatnonzero(high > low)
        for a in np.unique(low[inner]):
            rows = inner[low[inner] == a]
            b = high[rows[0]]
            out[rows] = a + np.searchsorted(ids[a:b], d[rows], "right")
        return pd.Series(out.astype(np.int32))

    return find(F.col("_h"), F.col("_d"))


def _piece_of(pieces: np.ndarray, first_piece: np.ndarray):
    """A column of the piece of range _r that row number _n falls in."""

    @F.pandas_udf(T.IntegerType())
    def find(r: pd.Series, n: pd.Series) -> pd.Series:
        r, n = r.to_numpy(), n.to_numpy()
        return pd.Series((first_piece[r] + n % pieces[r]).astype(np.int32))

    return find(F.col("_r"), F.pmod(F.xxhash64("_n"), F.lit(1 << 40)))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _h, _d (the key), _size (UTF-8 bytes plus 1) and _n, a row
    number to tell rows of one key apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = {} if "_n" in docs.columns else {"_n": F.monotonically_increasing_id()}
    return docs.withColumns({"_h": F.xxhash64(text), "_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), "_size": (F.octet_length(text) + 1).cast("long"), **n})


_LAST = -LEAST - 1
_BOUNDS = "_h long, _d long"


def _cut(of: np.ndarray, ids: np.ndarray):
    """Quantile keys of a range's samples (_r, _h, _d, _w), as many as it needs
    pieces (of, by range) less one. A key that takes several quantiles is
    heavy: it is cut off on both sides, so that it ends up alone. The key is
    the text's hash, or in a range of one text (ids, by range) also the id."""

    def cut(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        inside, pieces = bool(ids[key[0]]), int(of[key[0]])
        rows = rows.sort_values(["_h", "_d"])
        h, d = rows["_h"].to_numpy(), rows["_d"].to_numpy() if inside else np.full(len(rows), LEAST)
        total = np.cumsum(rows["_w"].to_numpy())
        at = np.minimum(np.searchsorted(total, total[-1] * np.arange(1, pieces) / pieces), len(rows) - 1)
        h, d = h[at], d[at]
        again = np.flatnonzero((h[1:] == h[:-1]) & (d[1:] == d[:-1]))
        after = (h[again], np.minimum(d[again], _LAST - 1) + 1) if inside else (np.minimum(h[again], _LAST - 1) + 1, d[again])
        return pd.DataFrame({"_h": np.append(h, after[0]), "_d": np.append(d, after[1])}).drop_duplicates()

    return cut


def _where(wanted: np.ndarray) -> Column:
    """Whether range _r is wanted."""

    @F.pandas_udf(T.BooleanType())
    def find(r: pd.Series) -> pd.Series:
        return pd.Series(wanted[r.to_numpy()])

    return find(F.col("_r"))


def _sums(keys: DataFrame, by: Column, n: int) -> pd.DataFrame:
    """bytes and rows of n ranges or pieces, and whether one has one text, and
    one key at most."""
    least, most = F.min(F.struct("_h", "_d")), F.max(F.struct("_h", "_d"))
    found = keys.groupBy(by.alias("r")).agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows"), (least["_h"] == most["_h"]).alias("text"), (least == most).alias("key")).toPandas()
    found = found.assign(bytes=found["bytes"].fillna(0), text=found["text"].fillna(True), key=found["key"].fillna(True))
    out = pd.DataFrame({"bytes": np.zeros(n, np.int64), "rows": np.zeros(n, np.int64), "text": np.ones(n, bool), "key": np.ones(n, bool)})
    for c in out.columns:
        out.loc[found["r"], c] = found[c].to_numpy(out[c].dtype)
    return out


def plan_shards(keys: DataFrame, n_shards: int = N_SHARDS, seed: int = 11) -> Plan:
    """Splitters for keys (columns _h, _d, _size, _n), a written table. It is
    read twice a round; a round cuts every range that is overfull and holds
    more than one key, and rounds go on until there is none. The first makes
    COARSE ranges at most, those after it as many as ROWS_A_RANGE asks for."""
    rows, total = keys.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    n_ranges = max(n_shards * RANGES_A_SHARD, rows // ROWS_A_RANGE)
    goal = max(1.0, total / n_ranges)
    hashes, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
    range_of = lambda: _range_of(hashes, ids) if len(hashes) else F.lit(0)
    sums, at = _sums(keys, F.lit(0), 1), 0
    while True:
        size, one_text, one_key = (sums[c].to_numpy() for c in ("bytes", "text", "key"))
        over = ((size > OVERFULL * goal) if at else (size >= 0)) & ~one_key.astype(bool)
        if not over.any():
            break
        of = np.minimum(np.ceil(2 * size / goal) if at else np.full(1, n_ranges), COARSE).astype(np.int64)
        expected = F.col("_size") * F.lit(SAMPLES_A_RANGE / goal) if at else F.col("_size") * F.lit(SAMPLES_A_RANGE * min(n_ranges, COARSE) / max(1, total))
        uniform = (F.pmod(F.xxhash64("_h", "_d", "_n", F.lit(seed + at)), F.lit(1 << 40)) / F.lit(float(1 << 40))).cast("double")
        ranged = keys.withColumn("_r", range_of())
        drawn = ranged.where(uniform < expected).where(_where(over)).select("_r", "_h", "_d", F.greatest(F.lit(1.0), expected).alias("_w"))
        new = drawn.groupBy("_r").applyInPandas(_cut(of, one_text.astype(bool)), _BOUNDS).toPandas()
        both = pd.concat([new, pd.DataFrame({"_h": hashes, "_d": ids})]).drop_duplicates().sort_values(["_h", "_d"])
        at += 1
        if len(both) == len(hashes):
            continue  # by chance nothing was drawn; the next round draws others
        hashes, ids = both["_h"].to_numpy(np.int64), both["_d"].to_numpy(np.int64)
        sums = _sums(keys, range_of(), len(hashes) + 1)
    size, count, one_key = (sums[c].to_numpy() for c in ("bytes", "rows", "key"))
    heavy = one_key.astype(bool) & (count > 1) & (size > OVERFULL * goal)
    pieces = np.where(heavy, np.minimum(count, np.ceil(size / goal)), 1).astype(np.int64)
    first_piece = np.cumsum(pieces) - pieces
    if heavy.any():
        sums = _sums(keys.withColumn("_r", range_of()), _piece_of(pieces, first_piece), pieces.sum())
    by_bytes, by_rows = sums["bytes"].to_numpy(np.int64), sums["rows"].to_numpy(np.int64)
    middle = np.cumsum(by_bytes) - by_bytes / 2
    shard = np.minimum(n_shards - 1, np.floor(middle * n_shards / max(1, total))).astype(np.int32)
    first = np.cumsum(by_rows) - by_rows
    first -= first[np.searchsorted(shard, shard, "left")]
    return Plan(hashes, ids, pieces, first_piece, shard, first)


def assign(keys: DataFrame, plan: Plan) -> DataFrame:
    """keys with shard (int) and slot (long); drops the key columns. The window
    runs over a piece of a range, never over a shard."""
    shard, first = plan.shard, plan.first_slot

    @F.pandas_udf(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("first", T.LongType())]))
    def place(r: pd.Series) -> pd.DataFrame:
        r = r.to_numpy()
        return pd.DataFrame({"shard": shard[r], "first": first[r]})

    ranged = keys.withColumn("_r", _range_of(plan.hashes, plan.ids))
    if plan.splits_rows():
        ranged = ranged.withColumn("_r", _piece_of(plan.pieces, plan.first_piece))
    at = F.row_number().over(Window.partitionBy("_r").orderBy("_h", "_d", "_size", "_n"))
    return ranged.withColumn("_p", place("_r")).withColumns({"shard": F.col("_p.shard"), "slot": F.col("_p.first") + at - 1}).drop("_h", "_d", "_size", "_n", "_r", "_p")


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """docs with shard and slot, shards of nearly equal bytes. Ties: rows of
    equal text and id are in order of a row number, so which of them has which
    slot is of no account.

    Equal texts share a shard unless their group is larger than a fine range
    (a 64th of a shard). A null text counts as empty, a null doc_id sorts
    first; a text of any length is one record; repeated rows each get a slot
    and, where they are larger than a fine range, are split by a row number
    (docs are then written once, so that the number holds); an empty table
    gives an empty result; columns of docs named shard or slot are replaced,
    all others stay, whatever their names.
    """
    docs = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("shard", "slot")]).alias("_doc"))
    plan = plan_shards(written(keyed(docs).select("_h", "_d", "_size", "_n"), "keys"), n_shards)
    if plan.splits_rows():
        docs = written(docs.withColumn("_n", F.monotonically_increasing_id()), "numbered")
        plan = plan_shards(written(keyed(docs).select("_h", "_d", "_size", "_n"), "keys"), n_shards)
    return assign(keyed(docs).drop("doc_id", "text"), plan).select("_doc.*", "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's shard and slot under the law `bytes`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = written(keyed(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("text_crc32", F.crc32(text)).drop("text"), "keys")
    placed = assign(keys.withColumn("size", F.col("_size")), plan_shards(keys))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
