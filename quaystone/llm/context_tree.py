"""Language-model scoring by context-tree weighting over bytes.

Each byte is eight binary decisions; each decision has a node in the contexts
of 0 to DEPTH preceding bytes. A node's Krichevsky-Trofimov estimate and the
product of its children's weighted probabilities are mixed half and half, all
the way up, so the probability of a byte mixes the estimates of all depths and
its code length is the negative logarithm. A text ends with a zero byte and
begins after zero bytes. Where a context was never seen, the mix ends at the
deepest one that was.

Grams of DEPTH + 1 bytes of all texts are counted within tasks, then summed by
Spark, those of training texts apart. Everything below two bytes of context is
a tree, so trees are weighted in parallel; a tree of more than GRAMS_A_TREE
grams is several, by the third byte. The nodes of two bytes are a table, joined
back to the trees that hang from them, and only sums over one byte of context
(at most 256 x 255 rows) reach the driver. Each tree gives the code length of every gram
that any text has, so the model grows with the corpus and nothing is merged or
left out.

To score, grams with at least a 2**-GRAM_BITS share of all grams (so at most
2**GRAM_BITS of them) are broadcast with their code lengths; the others are
looked up by a shuffle join, in which no key is hot since each is rare. Words
of the base score, unigrams with one added, go the same two ways, with
2**HEAD_BITS as the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.llm import textscan
from quaystone.llm.shared import bounded_batches, width, written
from quaystone.session import table

DEPTH = 5
GRAM_BITS = 23
HEAD_BITS = 22
#: Distinct grams of a partition of trees, at most, where no tree is larger.
GRAMS_A_PART = 2_000_000
#: Distinct grams of a tree, beyond which it is dealt in parts (at most 256) by its third byte of context.
GRAMS_A_TREE = 20_000
#: Keys counted together before they are merged with a task's other counts.
MERGE = 6_000_000
#: The largest direct table of frequent grams in a worker (2**INDEX_BITS places of 16 bytes).
INDEX_BITS = 23
_U = np.uint64
_HALF = np.log(0.5)


def _grams(c: textscan.Chunk, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end: the byte (low 8 bits) and the depth bytes before
    it, nearest lowest; and the text each belongs to."""
    n = np.diff(c.offsets)
    row = np.repeat(np.arange(c.n), n)
    data = np.zeros(len(c.data) + depth * (c.n + 1), np.uint8)
    at = np.arange(len(c.data)) + depth * (row + 1)
    data[at] = c.data
    ends = c.offsets[1:] + depth * np.arange(1, c.n + 1)
    use = np.zeros(len(data), bool)
    use[at] = True
    use[ends] = True
    key = data[depth:].astype(np.uint64)
    for j in range(1, depth + 1):
        key |= data[depth - j : len(data) - j].astype(np.uint64) << _U(8 * j)
    return key[use[depth:]], np.repeat(np.arange(c.n), n + 1)


def _summed(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[start], np.add.reduceat(count[order], start) if len(start) else count[:0]


def _count(depth: int):
    """(kind, key, n) of one task: grams (0), word hashes (1) and texts (2) to
    learn from, and grams of held-out texts (3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = 0, 1, 3
        held: tuple = ([], []), ([], []), ([], [])
        raw: tuple = [], [], []
        weight, texts = 0, 0

        def merge() -> None:
            for (keys, counts), new in zip(held, raw, strict=True):
                if new:
                    key = np.sort(np.concatenate(new))
                    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                    key, count = _summed([*keys, key[start]], [*counts, np.diff(np.append(start, len(key)))])
                    keys[:], counts[:], new[:] = [key], [count], []

        def count(text: pa.Array, learn: bool) -> None:
            nonlocal weight
            for c in textscan.chunks(text):
                raw[0 if learn else 2].append(_grams(c, depth)[0])
                weight += len(c.data) + c.n
                if learn:
                    s, e, _ = c.words()
                    raw[1].append(c.word_hashes(s, e))
                    weight += len(s)
                if weight >= MERGE:
                    merge()
                    weight = 0

        for batch in batches:
            out = batch["held_out"]
            texts += batch.num_rows - (out.true_count or 0)
            count(batch["text"].filter(pc.invert(out)), True)
            count(batch["text"].filter(out), False)
        merge()
        for kind, (keys, counts) in zip(kinds, held, strict=True):
            for key, count in zip(keys, counts, strict=True):
                for at in range(0, len(key), 1 << 18):
                    k = key[at : at + (1 << 18)].view(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(count[at : at + (1 << 18)].astype(np.int64))], ["kind", "key", "n"])
        if texts:
            yield pa.record_batch([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], ["kind", "key", "n"])

    return run


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series; small x is raised by 8 and taken back by the recurrence."""
    low = x < 100
    y = np.where(low, x + 8, x)
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    back, z = np.zeros(len(x)), np.where(low, x, 1.0)
    for j in range(8):
        back += np.log(z + j)
    return np.where(low, series - back, series)


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - np.log(np.pi) - _log_gamma(n0 + n1 + 1)


def _nodes(gram: np.ndarray, count: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (context << 8 | decision, decision from 1 to 255) of one depth and
    their zeros and ones, from the counts of grams."""
    key, n = _summed([gram & _U((1 << 8 * (depth + 1)) - 1)], [count])
    byte, context = key & _U(255), key >> _U(8)
    nodes, bits = [], []
    for level in range(8):
        nodes.append(context << _U(8) | _U(1 << level) | byte >> _U(8 - level))
        bits.append(byte >> _U(7 - level) & _U(1))
    node, bit, n = np.concatenate(nodes), np.concatenate(bits), np.tile(n, 8)
    node, which = np.unique(node, return_inverse=True)
    which = which.ravel()
    return node, np.bincount(which, n * (bit == 0), len(node)), np.bincount(which, n * (bit == 1), len(node))


def _parents(node: np.ndarray, depth: int) -> np.ndarray:
    """The same decision one byte of context shorter."""
    return (node >> _U(8) & _U((1 << 8 * (depth - 1)) - 1)) << _U(8) | node & _U(255)


def _weighted(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability, and the share of the node's own estimate in
    it; below: sum of the children's, None at the full depth."""
    own = _log_kt(n0, n1)
    if below is None:
        return own, np.ones(len(own))
    log_w = np.logaddexp(_HALF + own, _HALF + below)
    return log_w, np.exp(_HALF + own - log_w)


def _trees(gram: np.ndarray, count: np.ndarray, depth: int) -> dict[int, tuple]:
    """Depth -> (node, n0, n1, log weighted, own share), from 3 to depth."""
    out, below = {}, None
    for d in range(depth, 2, -1):
        node, n0, n1 = _nodes(gram, count, d)
        log_w, share = _weighted(n0, n1, below)
        out[d] = (node, n0, n1, log_w, share)
        up, which = np.unique(_parents(node, d), return_inverse=True)
        below = np.bincount(which.ravel(), log_w, len(up))  # in the order of the next depth's nodes
    return out


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (n1 + 0.5) / (n0 + n1 + 1)


def _held(batches: list[pa.RecordBatch], *names: str) -> list[np.ndarray]:
    t = pa.Table.from_batches(batches)
    return [t[c].to_numpy().view(np.uint64) if c in ("key", "node") else t[c].to_numpy() for c in names]


_SUMS = "node long, n0 double, n1 double, below double"


def _upper(depth: int):
    """Nodes of two bytes of context: counts and children's log weighted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        node, n0, n1, log_w, _ = _trees(*_held(batches, "key", "n"), depth)[3]
        up, which = np.unique(_parents(node, 3), return_inverse=True)
        yield pa.record_batch([pa.array(up.view(np.int64)), *[pa.array(np.bincount(which.ravel(), x, len(up))) for x in (n0, n1, log_w)]], ["node", "n0", "n1", "below"])

    return run


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From nodes of two bytes those of one, in the same form."""
    for batch in batches:
        if not batch.num_rows:
            continue
        node, n0, n1, below = _held([batch], "node", "n0", "n1", "below")
        up, which = np.unique(_parents(node, 2), return_inverse=True)
        yield pa.record_batch([pa.array(up.view(np.int64)), *[pa.array(np.bincount(which.ravel(), x, len(up))) for x in (n0, n1, _weighted(n0, n1, below)[0])]], ["node", "n0", "n1", "below"])


def _settled(sent):
    """Nodes of two bytes with known, mixed and left, as _top gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = sent.value
        for batch in batches:
            node, n0, n1, below = _held([batch], "node", "n0", "n1", "below")
            at = np.searchsorted(top["known"][1][0], _parents(node, 2))
            _, share = _weighted(n0, n1, below)
            before, rest, kt = top["mixed"][at], top["left"][at], _kt(n0, n1)
            columns = before + rest * kt, before + rest * share * kt, rest * (1 - share)
            yield pa.record_batch([batch["node"], *map(pa.array, columns)], ["node", "known", "mixed", "left"])

    return run


def _top(one: list) -> dict:
    """What the trees hang from: nodes of no and one byte of context with their
    probabilities of a one, and what deeper estimates add to those of one byte
    (mixed) and weigh (left)."""
    node = np.array([r["node"] for r in one], np.uint64)
    n0, n1, below = (np.array([r[c] for r in one], np.float64) for c in ("n0", "n1", "below"))
    log_w, share = _weighted(n0, n1, below)
    root, which = np.unique(node & _U(255), return_inverse=True)
    which = which.ravel()
    r0, r1, r_below = (np.bincount(which, x, len(root)) for x in (n0, n1, log_w))
    _, r_share = _weighted(r0, r1, r_below)
    r_kt, kt = _kt(r0, r1), _kt(n0, n1)
    mixed, left = (r_share * r_kt)[which], (1 - r_share)[which]
    return {"known": [(root, r_kt), (node, mixed + left * kt)], "mixed": mixed + left * share * kt, "left": left * (1 - share)}


def _code(gram: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log2 of the probability of each gram's byte after its context; known:
    sorted nodes and their probabilities of a one, by depth."""
    total = np.zeros(len(gram))
    byte, context = gram & _U(255), gram >> _U(8)
    for level in range(8):
        decision = _U(1 << level) | byte >> _U(8 - level)
        p, todo = np.full(len(gram), 0.5), np.arange(len(gram))
        for d in range(len(known) - 1, -1, -1):
            names, values = known[d]
            if not len(todo) or not len(names):
                continue
            node = (context[todo] & _U((1 << 8 * d) - 1)) << _U(8) | decision[todo]
            at = np.minimum(np.searchsorted(names, node), len(names) - 1)
            hit = names[at] == node
            p[todo[hit]] = values[at[hit]]
            todo = todo[~hit]
        total += np.log2(np.where(byte >> _U(7 - level) & _U(1), p, 1 - p))
    return total


def _codes(depth: int, sent):
    """(key, n, code) of all grams of some parts of trees: how often all texts
    have it, and log2 of its probability. Rows of kind 1 are nodes of two bytes
    that the parts hang from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        kind, key, n, *above = _held(batches, "kind", "key", "n", "known", "mixed", "left")
        node, which = np.unique(key[kind == 1], return_index=True)
        value, mixed, left = (x[kind == 1][which] for x in above)
        known = [*sent.value["known"], (node, value)]
        key, n, learnt = key[kind != 1], n[kind != 1], (kind == 0)[kind != 1]
        if learnt.any():
            trees = _trees(key[learnt], n[learnt], depth)
            names = node
            for d in range(3, depth + 1):
                node, n0, n1, _, share = trees[d]
                at = np.searchsorted(names, _parents(node, d))
                before, rest, kt = mixed[at], left[at], _kt(n0, n1)
                known.append((node, before + rest * kt))
                names, mixed, left = node, before + rest * share * kt, rest * (1 - share)
        if not len(key):
            return
        key, n = _summed([key], [n])
        for at in range(0, len(key), 1 << 18):
            b = slice(at, at + (1 << 18))
            yield pa.record_batch([pa.array(key[b].view(np.int64)), pa.array(n[b]), pa.array(_code(key[b], known))], ["key", "n", "code"])

    return run


def gram_codes(counted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, n, code) of all grams, from counted (kind, key, n), a written table."""
    if depth < 3:
        raise ValueError("large trees are dealt by a third byte of context")
    spark = counted.sparkSession
    grams = counted.where("kind in (0, 3)").withColumn("pair", F.shiftright("key", 8).bitwiseAND(0xFFFF).cast("int"))
    sizes = written(grams.groupBy("pair").agg(F.count("*").alias("size")).withColumn("trees", F.least(F.ceil(F.col("size") / GRAMS_A_TREE), F.lit(256)).cast("int")), "sizes")
    parts = width(spark, sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0], GRAMS_A_PART)
    # at most 65,536 pairs
    grams = grams.join(F.broadcast(sizes.select("pair", "trees")), "pair").withColumn("tree", F.pmod(F.xxhash64(F.shiftright("key", 24).bitwiseAND(0xFF)), F.col("trees")).cast("int"))
    sums = lambda df: df.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")])
    learnt = grams.where("kind = 0").repartition(parts, "pair", "tree").select("key", "n")
    two = written(sums(learnt.mapInArrow(_upper(depth), _SUMS)), "pairs")
    top = spark.sparkContext.broadcast(_top(sums(two.mapInArrow(_roots, _SUMS)).orderBy("node").collect()))
    settled = two.mapInArrow(_settled(top), "node long, known double, mixed double, left double")
    none = F.lit(None).cast("double")
    # the nodes of two bytes go to each part of their tree
    hung = settled.withColumn("pair", F.shiftright("node", 8).cast("int")).join(F.broadcast(sizes.select("pair", "trees")), "pair")
    hung = hung.select(F.lit(1).alias("kind"), F.col("node").alias("key"), F.lit(0).cast("long").alias("n"), "known", "mixed", "left", "pair", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
    rows = grams.select("kind", "key", "n", none.alias("known"), none.alias("mixed"), none.alias("left"), "pair", "tree").unionByName(hung)
    rows = rows.repartition(parts, "pair", "tree").drop("pair", "tree")
    return written(rows.mapInArrow(_codes(depth, top), "key long, n long, code double"), "codes")


class Frequent:
    """Code lengths of frequent grams: a direct table, in which the more
    frequent of two that meet stays, and a sorted list of those that lost."""

    def __init__(self, key: np.ndarray, code: np.ndarray):
        """key: in ascending order of frequency."""
        self.key, self.code, self.place = key, code, None

    def _load(self) -> None:
        self.shift = _U(64 - min(INDEX_BITS, max(10, int(len(self.key)).bit_length() + 2)))
        size = 1 << (64 - int(self.shift))
        self.place, self.value = np.full(size, ~_U(0)), np.zeros(size, np.float32)
        at = self._at(self.key)
        self.place[at], self.value[at] = self.key, self.code
        lost = np.flatnonzero(self.place[at] != self.key)
        lost = lost[np.argsort(self.key[lost])]
        self.key, self.code = self.key[lost], self.code[lost]

    def _at(self, gram: np.ndarray) -> np.ndarray:
        return (gram * _U(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code of each gram, 0 where it is not here, and where that is."""
        if self.place is None:
            self._load()
        at = self._at(gram)
        out = self.value[at]
        miss = np.flatnonzero(self.place[at] != gram)
        out[miss] = 0
        if len(miss) and len(self.key):
            i = np.minimum(np.searchsorted(self.key, gram[miss]), len(self.key) - 1)
            hit = self.key[i] == gram[miss]
            out[miss[hit]] = self.code[i[hit]]
            miss = miss[~hit]
        return out, miss


_SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, head double, head_known long, score double, n_bytes long, tail array<long>, grams array<long>"


def _listed(owner: np.ndarray, key: np.ndarray, n: int) -> pa.ListArray:
    """The keys of each of n texts; owner: ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(key.view(np.int64)))


def _scores(depth: int, frequent, head):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 40
        code, (words, counts) = frequent.value, head.value
        logs = np.append(np.log10(counts + 1.0), 0.0)
        for batch in batches:
            for c in textscan.chunks(batch["text"]):
                gram, row = _grams(c, depth)
                value, far = code(gram)
                score = np.bincount(row, value, c.n)
                grams = _listed(row[far], gram[far], c.n)
                s, e, first = c.words()
                h = c.word_hashes(s, e)
                n = np.diff(first)
                owner = np.repeat(np.arange(c.n), n)
                at = np.searchsorted(words, h)
                at[at == len(words)] = 0
                known = (words[at] == h) if len(words) else np.zeros(len(h), bool)
                at[~known] = len(counts)
                rest = np.flatnonzero(~known)
                tail = _listed(owner[rest], h[rest], c.n)
                part = batch.slice(c.first, c.n)
                yield pa.record_batch(
                    [
                        pa.array(np.arange(uid, uid + c.n)),
                        part["doc_id"],
                        part["held_out"],
                        pa.array(n.astype(np.int64) + 1),
                        pa.array(np.bincount(owner, logs[at], c.n) if len(owner) else np.zeros(c.n)),
                        pa.array(np.bincount(owner, known, c.n).astype(np.int64) if len(owner) else np.zeros(c.n, np.int64)),
                        pa.array(score),
                        pa.array(np.diff(c.offsets)),
                        tail,
                        grams,
                    ],
                    ["uid", "doc_id", "held_out", "n_tokens", "head", "head_known", "score", "n_bytes", "tail", "grams"],
                )
                uid += c.n

    return run


def score_texts(docs: DataFrame, held_out, depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and
    code_length (bits a byte, ends included) of each row of docs, by a model of
    the rows for which the column held_out is not true.

    A null or empty text is its end alone; a text of any length is counted and
    scored whole. A null doc_id is carried along; repeated rows count and are
    scored each; an empty table gives an empty result; other columns, whatever
    their names, are ignored; without training rows every decision costs a bit.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counted = docs.select("text", "held_out").mapInArrow(_count(depth), "kind int, key long, n long")
    counted = written(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    kind = F.col("kind")
    words, kinds, texts, all_grams = counted.agg(F.sum(F.when(kind == 1, F.col("n"))), F.count_if(kind == 1), F.sum(F.when(kind == 2, F.col("n"))), F.sum(F.when(kind.isin(0, 3), F.col("n")))).first()
    texts = texts or 0
    n = (words or 0) + texts
    v = kinds + (texts > 0)
    least = max(1, -(-n // (1 << HEAD_BITS)))
    often = counted.where((kind == 1) & (F.col("n") >= least)).select("key", "n").toArrow()
    key, count = often["key"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(key)
    codes, least_gram = gram_codes(counted, depth), max(1, -(-(all_grams or 0) // (1 << GRAM_BITS)))
    often = codes.where(F.col("n") >= least_gram).toArrow()
    rank = np.argsort(often["n"].to_numpy(), kind="stable")
    frequent = Frequent(often["key"].to_numpy().view(np.uint64)[rank], often["code"].to_numpy()[rank].astype(np.float32))
    context = docs.sparkSession.sparkContext
    scored = written(docs.mapInArrow(_scores(depth, context.broadcast(frequent), context.broadcast((key[order], count[order]))), _SCORED), "scored")
    rare = counted.where((kind == 1) & (F.col("n") < least)).select(kind, "key", F.log10(F.col("n") + 1.0).alias("x"))
    rare = rare.unionByName(codes.where(F.col("n") < least_gram).select(F.lit(0).alias("kind"), "key", F.col("code").cast("float").cast("double").alias("x")))
    far = scored.select("uid", F.lit(1).alias("kind"), F.explode("tail").alias("key")).unionByName(scored.select("uid", F.lit(0).alias("kind"), F.explode("grams").alias("key")))
    is_word = F.col("kind") == 1
    tail = far.join(rare, ["kind", "key"]).groupBy("uid").agg(
        F.sum(F.when(is_word, F.col("x"))).alias("tail_log"), F.count_if(is_word).alias("tail_known"), F.sum(F.when(~is_word, F.col("x"))).alias("tail_code")
    )
    base = F.col("head") + F.coalesce("tail_log", F.lit(0.0)) + float(np.log10(texts + 1.0)) - F.col("n_tokens") * float(np.log10(n + v + 1.0))
    bits = F.col("score") + F.coalesce("tail_code", F.lit(0.0))
    return scored.join(tail, "uid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + int(texts > 0)).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (bits * float(np.log10(2))).alias("score"),
        (-bits / (F.col("n_bytes") + 1)).alias("code_length"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over all documents."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    return score_texts(table(spark, sf_dir, "documents"), held_out)
