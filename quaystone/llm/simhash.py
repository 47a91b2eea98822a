"""Near duplicates by SimHash fingerprints, joined on a grid of bit counts.

A fingerprint is cut into segments and mapped to the number of bits set in
each. A differing bit moves one count by one, so the Manhattan distance of two
such points never exceeds the fingerprints' Hamming distance: points further
apart than BITS need no look. The points lie on a grid; a fingerprint is at
home in its own cell and visits the cells around it within BITS steps, of each
pair of opposite steps one, so a pair meets once. Who meets there is verified
by the exact number of differing bits.

Equal fingerprints are one from the start. How many segments the grid has
follows from counted occupancy: more make cells emptier, but a fingerprint's
visits grow with their square. Cells that stay crowded are dealt by a hash of
their residents, and visitors go to each share. A task holds one cell's
residents at a time and gives a spanning forest of the links it finds, so what
comes out is bounded by the fingerprints that went in, not by the pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm.shared import bounded_batches, connected_components, small, width, written
from quaystone.session import table

SHINGLE = 3
SEED = 42
#: Fingerprints link when they differ in at most so many bits.
BITS = 2
#: Grids to choose from, by their number of segments.
GRIDS = (4, 6, 8, 12, 16)
#: Residents of a cell from which it is dealt in shares.
CROWD = 4096
#: Visits of a partition.
A_PART = 2_000_000
#: What a shuffled visit costs, in compared pairs.
VISIT = 50
#: Bytes of a text whose words are taken, hashes counted, and pairs compared, at a time.
PIECE = 1 << 20
HASHES = 1 << 16
PAIRS = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, PIECE bytes or a little more at a time."""
    at = 0
    while at < len(data):
        blank = _BLANK.search(data, at + PIECE)
        end = blank.start() if blank else len(data)
        yield data[at:end].split()  # of bytes: the six blanks alone
        at = end


def _hashes(words: list[bytes], k: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of k words."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)[: len(words) - k + 1]
    ends = ends[k - 1 :]
    of = xxhash.xxh64_intdigest
    for at in range(0, len(begins), HASHES):
        cut = zip(begins[at : at + HASHES].tolist(), ends[at : at + HASHES].tolist(), strict=True)
        yield np.array([of(joined[a:b], SEED) for a, b in cut], np.uint64)


def shingle_hashes(text: str | None, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of a text's k-word shingles, repeats included, in pieces; with
    fewer words the whole sequence, without words nothing. Memory follows the
    piece, or the longest word, not the number of words."""
    held: list[bytes] = []
    whole = True
    for words in _pieces((text or "").encode().lower()):  # of bytes: A-Z alone
        held += words
        if len(held) >= k:
            yield from _hashes(held, k)
            held, whole = held[len(held) - k + 1 :], False
    if whole and held:
        yield from _hashes(held, len(held))


def fingerprint(text: str | None) -> int:
    """Bit i is set if over half of the shingle hashes have it; zero without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch["text"]], np.uint64)
        yield pa.record_batch([batch["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])


def segments(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of n segments, as even as 64 allows."""
    ends = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _places(n: int) -> list[int]:
    """The weight of each segment's count in a cell's number. The base leaves
    BITS unused digits above the largest count, so a step out of the grid
    leads to no other cell of it."""
    base = max(w for _, w in segments(n)) + BITS + 1
    return [base**i for i in range(n)]


def cell(fp: Column, n: int) -> Column:
    """The number of a fingerprint's cell in the grid of n segments."""
    counts = [F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << w) - 1))).cast("long") * F.lit(place).cast("long") for (at, w), place in zip(segments(n), _places(n), strict=True)]
    return sum(counts[1:], counts[0])


def steps(n: int) -> list[int]:
    """From a cell to those within BITS steps whose number is not smaller: of
    each pair of opposite steps one, and no step at all."""
    moves = {0}
    for place in _places(n):
        moves |= {j * place for j in range(-BITS, BITS + 1)}
    for a, b in combinations(_places(n), 2):
        moves |= {s * a + t * b for s in (-1, 1) for t in (-1, 1)}
    return sorted(m for m in moves if m >= 0)


def grid_of(points: DataFrame) -> int:
    """The grid with the least work over points (fp), all counted: visits of
    every point, and pairs, as many as a cell's residents meet in cells as full
    as their own."""

    def work(n: int) -> float:
        count, square = points.groupBy(cell(F.col("fp"), n).alias("cell")).agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n").cast("double") * F.col("n"))).first()
        return len(steps(n)) * (VISIT * (count or 0) + (square or 0.0))

    return min(GRIDS, key=work)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least reachable node) that connect what links a-b connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, share, visits) to links: residents of a share are
    held until it ends, visitors pass by in the batches they come in."""
    kind = [("cell", np.int64), ("share", np.int64)]
    held, home = np.zeros(0, kind), np.zeros(0, np.uint64)
    for batch in batches:
        key = np.zeros(len(batch), kind)
        key["cell"], key["share"] = batch["cell"].to_numpy(), batch["share"].to_numpy()
        fp = batch["fp"].to_numpy().view(np.uint64)
        visits = batch["visits"].to_numpy(zero_copy_only=False).astype(bool)
        held, home = np.concatenate([held, key[~visits]]), np.concatenate([home, fp[~visits]])
        # residents and visitors are both in order: number the shares, then find each visitor's
        start = np.flatnonzero(np.append(True, held[1:] != held[:-1]))[: len(held)]
        end = np.append(start[1:], len(held))
        came, who = key[visits], fp[visits]
        at = _found(held[start], came)
        there = at >= 0
        who, at = who[there], at[there]
        n = (end - start)[at]
        total = np.append(0, np.cumsum(n))
        left, right = [], []
        done = 0
        while done < len(who):
            stop = max(done + 1, int(np.searchsorted(total, total[done] + PAIRS, "right")) - 1)
            m = n[done:stop]
            visitor = np.repeat(who[done:stop], m)
            resident = home[np.repeat(start[at[done:stop]] - (total[done:stop] - total[done]), m) + np.arange(total[stop] - total[done])]
            near = (np.bitwise_count(visitor ^ resident) <= BITS) & (visitor != resident)
            if near.any():
                a, b = forest(visitor[near], resident[near])
                left.append(a)
                right.append(b)
            done = stop
        if left:
            a, b = forest(np.concatenate(left), np.concatenate(right))
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])
        stays = held == key[-1] if len(key) else np.ones(len(held), bool)
        held, home = held[stays], home[stays]


def _found(shares: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key is among shares, or -1."""
    if not len(shares) or not len(wanted):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(shares, wanted), len(shares) - 1)
    return np.where(shares[at] == wanted, at, -1)


def links(points: DataFrame, n: int | None = None, crowd: int = CROWD) -> DataFrame:
    """(src, dst) that connect the distinct fingerprints (fp) of points which
    are linked, directly or over others."""
    n = n or grid_of(points)
    home = points.select(cell(F.col("fp"), n).alias("cell"), "fp")
    crowded = written(home.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(F.col("cell").alias("full"), F.ceil(F.col("n") / crowd).cast("long").alias("shares")), "crowded")
    crowded = small(crowded)
    visits = home.select(F.explode(F.array(*[F.col("cell") + F.lit(s) for s in steps(n)])).alias("cell"), "fp")

    def shared(rows: DataFrame) -> DataFrame:
        return rows.join(crowded, rows["cell"] == crowded["full"], "left")

    residents = shared(home).select("cell", F.coalesce(F.pmod(F.xxhash64("fp"), "shares"), F.lit(0).cast("long")).alias("share"), F.lit(False).alias("visits"), "fp")
    visitors = shared(visits).select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("shares") - 1, F.lit(0).cast("long")))).alias("share"), F.lit(True).alias("visits"), "fp")
    parts = width(points.sparkSession, points.count() * len(steps(n)), A_PART)
    met = residents.unionByName(visitors).repartition(parts, "cell", "share").sortWithinPartitions("cell", "share", "visits", "fp")
    return met.mapInArrow(_met, "src long, dst long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and component_id of each
    row of docs (doc_id, text).

    Null, empty and wordless texts have fingerprint zero, which links like any
    other. Equal fingerprints link. A null doc_id is carried along and names no
    component unless no other id is there. Repeated rows come back as often as
    they were given; texts of any length are taken whole; an empty table gives
    an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    signed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long"), "fingerprints")
    points = written(signed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "points")
    label = connected_components(written(links(points), "links")).withColumnRenamed("node", "fp")
    labelled = written(points.join(label, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component")), "labelled")
    least = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = written(labelled.join(least, "component").select("fp", "component_id"), "named")
    return signed.join(small(named), "fp").select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13 over all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
