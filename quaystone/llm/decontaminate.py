"""Benchmark decontamination: size-partitioned MinHash containment search.

Containment of a short item in a long document is not a Jaccard question, so
only the item is sketched, and what is asked of a document depends on the
item's size: items are partitioned by the size of their set of 5-word
shingles, and an item of n shingles is represented by its bottom
n - ceil(0.8 n) + 1 MinHash values. A document that contains at least 80 % of
the item must hold one of them, so a probe of all shingles of the whole
document against the sketches of the size classes it is large enough for
misses nothing. Candidates are verified by exact containment of the item's
whole set.

The benchmark is the stated query set. Executors make its sets, which are
written to the shared folder in blocks of about BLOCK_BYTES; a Python worker
reads a block from there, keeps up to KEPT of them, and holds every batch of
documents against all blocks, so the documents are scanned once and nothing of
the benchmark passes through the driver. A benchmark of more blocks than that
is met by many batches at a time: their word hashes are gathered up to
GATHER_BYTES before the blocks are gone through, those still held first.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import textscan
from quaystone.llm.shared import bounded_batches, new_folder, small
from quaystone.llm.textscan import distinct, shingle_hashes
from quaystone.session import table

SHINGLE = 5
PERCENT = 80
#: Shingles of a block of items, 8 bytes each; an item is never cut.
BLOCK_BYTES = 32 << 20
KEPT = 3
#: Word hashes that a task gathers before it goes through more blocks than it keeps.
GATHER_BYTES = 96 << 20
_BITS = 20
_U = np.uint64


class Sketches:
    """One block of items: MinHash sketches by size class, and whole sets."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray]):
        self.ids = ids
        self.n = np.array([len(x) for x in sets], np.int64)
        least = -((-PERCENT * self.n) // 100)
        item = np.repeat(np.arange(len(sets)), self.n)
        tokens = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.items = tokens[order], item[order]
        self.classes = []
        size_class = np.ceil(np.log2(np.maximum(self.n, 1))).astype(int)
        #: by the low bits of a value: the fewest shingles a document needs for any class that has it
        self.needs = np.full(1 << _BITS, np.iinfo(np.int64).max)
        for c in np.unique(size_class[self.n > 0]):
            members = np.flatnonzero((size_class == c) & (self.n > 0))
            k = self.n[members] - least[members] + 1
            tok = np.concatenate([sets[i][:m] for i, m in zip(members, k, strict=True)])
            who = np.repeat(members, k)
            by = np.argsort(tok, kind="stable")
            low = (tok & _U((1 << _BITS) - 1)).astype(np.int64)
            bits = np.zeros(1 << _BITS, bool)
            bits[low] = True
            size = int(least[members].min())
            self.needs[low] = np.minimum(self.needs[low], size)
            self.classes.append((size, tok[by], who[by], bits))

    def _postings(self, tokens: np.ndarray, items: np.ndarray, x: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
        c = b - a
        end = np.cumsum(c)
        return items[np.arange(end[-1]) + np.repeat(a - end + c, c)] if len(end) else items[:0]

    def _contained(self, x: np.ndarray) -> Iterator[tuple[int, int]]:
        found = np.zeros(len(self.n), bool)
        low = (x & _U((1 << _BITS) - 1)).astype(np.int64)
        for least, tok, who, bits in self.classes:
            if len(x) >= least:
                found[self._postings(tok, who, x[bits[low]])] = True
        if found.any():
            shared = np.bincount(self._postings(self.tokens, self.items, x), minlength=len(self.n))
            for i in np.flatnonzero(found & (100 * shared >= PERCENT * self.n)):
                yield int(i), int(shared[i])

    def search(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of each contained item; text i has the
        word hashes words[first[i]:first[i + 1]]."""
        n = np.diff(first)
        rows = set(np.flatnonzero((n > 0) & (n < SHINGLE)).tolist())
        if len(words) >= SHINGLE:
            h = shingle_hashes(words, SHINGLE)
            doc = np.searchsorted(first, np.arange(len(h)), "right") - 1
            hit = self.needs[(h & _U((1 << _BITS) - 1)).astype(np.int64)] <= n[doc] - SHINGLE + 1
            hit &= np.arange(len(h)) + SHINGLE <= first[doc + 1]
            rows |= set(np.unique(doc[hit]).tolist())
        for i in sorted(rows):
            for item, shared in self._contained(distinct(shingle_hashes(words[first[i] : first[i + 1]], SHINGLE))):
                yield i, item, shared


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [x for _, x in textscan.shingle_sets(batch["text"], SHINGLE)]
        out = pa.record_batch([batch["item"], pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["item", "n", "tokens"])
        yield out.filter(pa.array([len(x) > 0 for x in sets], pa.bool_()))


class Benchmark:
    """The items' sets in blocks in the shared folder: item (a number of the
    row), its n shingles, its tokens. ids gives the item_id of each item."""

    def __init__(self, benchmark: DataFrame):
        spark = benchmark.sparkSession
        self.folder = new_folder(spark, "benchmark")
        rows = benchmark.select("item_id", "text").withColumn("item", F.monotonically_increasing_id())
        rows.write.parquet(f"{self.folder}/items")
        items = spark.read.parquet(f"{self.folder}/items")
        self.ids = items.select("item", "item_id")
        items.select("item", "text").mapInArrow(_sets, "item long, n long, tokens binary").write.parquet(f"{self.folder}/sets")
        sets = spark.read.parquet(f"{self.folder}/sets")
        self.n_blocks = -(-8 * (sets.agg(F.sum("n")).first()[0] or 0) // BLOCK_BYTES)
        if self.n_blocks:
            at = F.pmod(F.xxhash64("item"), F.lit(self.n_blocks)).cast("int")
            sets.withColumn("block", at).repartition(self.n_blocks, "block").write.partitionBy("block").parquet(f"{self.folder}/blocks")


_held: OrderedDict = OrderedDict()


def _block(folder: str, i: int) -> Sketches:
    """A block, read where it is needed and kept while it is among the KEPT
    most recently used ones of this worker."""
    key = folder, i
    if key not in _held:
        while len(_held) >= KEPT:
            _held.popitem(last=False)
        fs, root = pafs.FileSystem.from_uri(folder)
        t = pads.dataset(f"{root}/blocks/block={i}", filesystem=fs, format="parquet").to_table(columns=["item", "tokens"]) if fs.get_file_info(f"{root}/blocks/block={i}").type else None
        sets = [] if t is None else [np.frombuffer(x, np.uint64) for x in t["tokens"].to_pylist()]
        _held[key] = Sketches(np.zeros(0, np.int64) if t is None else t["item"].to_numpy(), sets)
    _held.move_to_end(key)
    return _held[key]


Hit = tuple[int, int, int, int]


def _hashed(texts: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, first word of each text) of each chunk."""
    out = []
    for c in textscan.chunks(texts):
        s, e, first = c.words()
        out.append((c.first, c.word_hashes(s, e), first))
    return out


def _hits(folder: str, n_blocks: int, batches: list[list]) -> list[list[Hit]]:
    """(row, item, shingles of the item, shared shingles) for each hashed
    batch; every block is read once, those that the worker holds first."""
    out: list[list[Hit]] = [[] for _ in batches]
    for b in sorted(range(n_blocks), key=lambda b: (folder, b) not in _held):
        block = _block(folder, b)
        for hits, chunks in zip(out, batches, strict=True):
            for start, words, first in chunks:
                for i, item, shared in block.search(words, first):
                    hits.append((start + i, int(block.ids[item]), int(block.n[item]), shared))
    return out


def _searched(folder: str, n_blocks: int, batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[tuple[pa.Array, list[Hit]]]:
    """(what came with the texts, hits) of each batch of (what, texts), in order."""
    what, hashed, size = [], [], 0
    for beside, texts in batches:
        what.append(beside)
        hashed.append(_hashed(texts))
        size += sum(words.nbytes for _, words, _ in hashed[-1])
        if n_blocks <= KEPT or size >= GATHER_BYTES:
            yield from zip(what, _hits(folder, n_blocks, hashed), strict=True)
            what, hashed, size = [], [], 0
    yield from zip(what, _hits(folder, n_blocks, hashed), strict=True)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item (shingles of the item), n_shared: one row for
    each row of docs and item of which it contains at least 80 %.

    Null or wordless texts and items contain and are contained in nothing; a
    text or item of any length is taken whole; ids may be of any type; a null
    id is carried along; repeated rows are reported each; an empty table gives
    an empty result; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    held = Benchmark(benchmark)
    folder, n_blocks = held.folder, held.n_blocks
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hits in _searched(folder, n_blocks, ((batch["doc_id"], batch["text"]) for batch in batches)):
            found = list(zip(*hits, strict=True)) or [()] * 4
            yield pa.record_batch([ids.take(pa.array(found[0], pa.int64())), *[pa.array(x, pa.int64()) for x in found[1:]]], ["doc_id", "item", "n_item", "n_shared"])

    schema = T.StructType([T.StructField("doc_id", kind), *[T.StructField(x, T.LongType()) for x in ("item", "n_item", "n_shared")]])
    hits = docs.select("doc_id", "text").mapInArrow(run, schema)
    return hits.join(small(held.ids), "item").select("doc_id", "item_id", "n_item", "n_shared")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that contain a benchmark item; its columns stay as
    they are, whatever their names. Texts are judged where they are read, so
    nothing is shuffled. A null or wordless text contains nothing and stays."""
    bounded_batches(docs.sparkSession)
    held = Benchmark(benchmark)
    return docs.where(~_leaks(held.folder, held.n_blocks)(F.col("text")))


def _leaks(folder: str, n_blocks: int):
    @F.arrow_udf(T.BooleanType())
    def leaks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for n, hits in _searched(folder, n_blocks, ((pa.nulls(len(texts)), texts) for texts in batches)):
            hit = np.zeros(len(n), bool)
            hit[sorted({row for row, *_ in hits})] = True
            yield pa.array(hit)

    return leaks


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all benchmark items against all documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
