"""Language ID of mixed-language text: script ranges, word scores, Viterbi.

Learned from labelled texts: for each language, counts of hashed byte trigrams
inside words and of hashed whole words, and the scripts its words are written
in. A word's script, from its first letter, narrows the languages it may be in;
its score for each of them is the log probability of its trigrams and itself.
Viterbi over a text's words, paying SWITCH for each change of language, labels
spans.

Viterbi runs side by side over the texts of a chunk. It is skipped where its
result is certain: if no stretch of words favours any other language over the
text's best one by SWITCH / 2, no change can pay. A path with m >= 2 stretches
of other languages pays at least m - 1 changes and gains less than m / 2 of
one each; a path with one such stretch and a change gains less than it pays,
and no other language alone beats the text's best.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.llm import textscan
from quaystone.llm.shared import bounded_batches
from quaystone.session import table

#: Cost of a change of language, in nats.
SWITCH = 12.0
#: Share of a language's words that a script must have to admit it.
SCRIPT_SHARE = 0.005
BITS = 16
MERGE = 1_500_000
#: The lowest score of a word against the best language for it.
FLOOR = -15.0
BARRED = -40.0

# First and last code point and name of the main scripts' blocks; letters of all others go by their names.
SCRIPTS = (
    (0x41, 0x5A, "Latin"), (0x61, 0x7A, "Latin"), (0xAA, 0xAA, "Latin"), (0xBA, 0xBA, "Latin"), (0xC0, 0x24F, "Latin"),
    (0x370, 0x3FF, "Greek"), (0x400, 0x52F, "Cyrillic"), (0x531, 0x58F, "Armenian"), (0x591, 0x5F4, "Hebrew"),
    (0x600, 0x6FF, "Arabic"), (0x750, 0x77F, "Arabic"), (0x900, 0x97F, "Devanagari"), (0x980, 0x9FF, "Bengali"),
    (0xA00, 0xA7F, "Gurmukhi"), (0xA80, 0xAFF, "Gujarati"), (0xB80, 0xBFF, "Tamil"), (0xC00, 0xC7F, "Telugu"),
    (0xC80, 0xCFF, "Kannada"), (0xD00, 0xD7F, "Malayalam"), (0xE00, 0xE7F, "Thai"), (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x30FF, "Kana"),
    (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0x20000, 0x2FA1F, "Han"),
)
NAMES = tuple(dict.fromkeys(x[2] for x in SCRIPTS))
# First words of letters' names that belong to a script above under another name.
ALIASES = {"CJK": "Han", "IDEOGRAPHIC": "Han", "HIRAGANA": "Kana", "KATAKANA": "Kana", "HALFWIDTH": "Kana", "FULLWIDTH": "Latin", "MODIFIER": "Latin"}
_CLASSES = 1 << 10


@cache
def _script_of_points() -> np.ndarray:
    """1 + the script of each code point, 0 if it has none. A letter outside
    the blocks above has the script that its Unicode name begins with."""
    names = {name: i + 1 for i, name in enumerate(NAMES)}
    script = np.zeros(sys.maxunicode + 1, np.uint16)
    for low, high, name in SCRIPTS:
        script[low : high + 1] = names[name]
    for point in np.flatnonzero(script[0x80:] == 0) + 0x80:
        if (x := chr(point)).isalpha():
            word = unicodedata.name(x, "OTHER").split()[0].partition("-")[0]
            name = ALIASES.get(word, word.title())
            script[point] = names.setdefault(name, len(names) + 1)
    if len(names) >= _CLASSES:
        raise ValueError(f"{len(names)} scripts, at most {_CLASSES - 1} have a count")
    return script


_ASCII = np.zeros(256, np.uint16)
_ASCII[65:91] = _ASCII[97:123] = NAMES.index("Latin") + 1
_SPACED = textscan.LOWER.copy()
_SPACED[textscan.GAP] = 32


def _script_of_words(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """1 + the script of each word's first letter, 0 without one."""
    script = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        padded = np.append(data, np.zeros(3, np.uint8)).astype(np.int32)
        b0, b1, b2, b3 = (padded[lead + j] for j in range(4))
        low = lambda b: b & 0x3F
        point = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | low(b1), np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | low(b1) << 6 | low(b2), (b0 & 7) << 18 | low(b1) << 12 | low(b2) << 6 | low(b3)))
        script[lead] = _script_of_points()[np.minimum(point, sys.maxunicode)]
    where = np.flatnonzero(script)
    if not len(where):
        return np.zeros(len(s), np.uint16)
    first = np.minimum(np.searchsorted(where, s), len(where) - 1)
    found = where[first]
    return np.where((found >= s) & (found < e), script[found], 0)


def _trigrams(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A bucket for each byte: it and the two before it in its word."""
    b0 = _SPACED[data]
    b1, b2 = np.empty_like(b0), np.empty_like(b0)
    b1[1:], b2[2:] = b0[:-1], b0[:-2]
    b1[s] = b2[s] = 32
    second = s + 1
    b2[second[second < e]] = 32
    h = b0.astype(np.uint32) * np.uint32(0x9E3779B1) + b1.astype(np.uint32) * np.uint32(0x85EBCA77) + b2.astype(np.uint32) * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.int32)


def _words(c: textscan.Chunk) -> tuple:
    s, e, first = c.words()
    return s, e, first, (c.word_hashes(s, e) >> np.uint64(64 - BITS)).astype(np.int32) + (1 << BITS)


def _counts(langs: list[str]):
    """(lang, bucket, n): trigrams below 2**BITS, words above, then scripts."""
    number = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, raw, weight = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            key, n = np.unique(np.concatenate(raw), return_counts=True)
            key, which = np.unique(np.concatenate([held[0], key]), return_inverse=True)
            return key, np.bincount(which.ravel(), np.concatenate([held[1], n]), len(key)).astype(np.int64)

        for batch in batches:
            lang = np.array([number.get(x, -1) for x in batch["lang"].to_pylist()], np.int64)
            for c in textscan.chunks(batch["text"]):
                s, e, first, word = _words(c)
                if not len(s):
                    continue
                script = _script_of_words(c.data, s, e)
                of = lang[c.first + np.repeat(np.arange(c.n), np.diff(first))]
                use = (script > 0) & (of >= 0)
                n = e - s
                inside = np.arange(n.sum()) + np.repeat(s - np.cumsum(n) + n, n)
                tri = _trigrams(c.data, s, e)[inside][np.repeat(use, n)]
                of_tri = np.repeat(of, n)[np.repeat(use, n)]
                raw += [of_tri << 20 | tri, of[use] << 20 | word[use], of[use] << 20 | (2 << BITS) + script[use].astype(np.int64)]
                weight += len(tri)
                if weight > MERGE:
                    held, raw, weight = merged(), [], 0
        if raw:
            held = merged()
        yield pa.record_batch([pa.array((held[0] >> 20).astype(np.int32)), pa.array((held[0] & 0xFFFFF).astype(np.int32)), pa.array(held[1])], ["lang", "bucket", "n"])

    return run


class Model:
    """Log probabilities by language and bucket, languages by script."""

    def __init__(self, langs: list[str], lang: np.ndarray, bucket: np.ndarray, n: np.ndarray):
        size = 1 << BITS
        count = np.zeros((len(langs), 2 * size + _CLASSES))
        count[lang, bucket] = n
        self.langs = langs
        tri, word = count[:, :size], count[:, size : 2 * size]
        log = lambda x: np.log((x + 0.5) / (x.sum(1, keepdims=True) + 0.5 * size)).astype(np.float32)
        self.tri, self.word = log(tri), log(word)
        script = count[:, 2 * size :]
        self.admits = script >= SCRIPT_SHARE * np.maximum(1, script.sum(1, keepdims=True))
        self.prior = int(np.argmax(script.sum(1))) if langs else -1

    def scores(self, c: textscan.Chunk, s: np.ndarray, e: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words by languages, the best 0, and whether a word counts at all:
        words without a letter, or of a script no language has, do not."""
        script = _script_of_words(c.data, s, e)
        tri = _trigrams(c.data, s, e)
        edges = np.column_stack([s, e]).ravel()
        edges = edges[:-1] if edges[-1] == len(c.data) else edges
        out = np.empty((len(s), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            out[:, k] = np.add.reduceat(self.tri[k][tri], edges)[::2] + self.word[k][word - (1 << BITS)]
        admitted = self.admits[:, script].T
        counts = (script > 0) & admitted.any(1)
        out[~admitted] = -np.inf
        out[~counts] = 0
        out -= out.max(1, keepdims=True)
        return np.where(np.isinf(out), BARRED, np.maximum(out, FLOOR)), counts


def viterbi(score: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """The label of each word; text i has the words first[i] to first[i + 1]."""
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    k = score.shape[1]
    total = np.stack([np.bincount(rows, score[:, j], len(n)) for j in range(k)], 1)
    best = total.argmax(1)
    label = best[rows]
    if k == 1 or not len(rows):
        return label
    gain = (score - score[np.arange(len(rows)), label][:, None]).astype(np.float64)
    begin = np.minimum(first[:-1], max(0, len(rows) - 1))
    most = np.zeros(len(n))
    for j in range(k):
        # sums from a text's first word; far lower for each text, so that the running minimum starts anew
        run = np.append(0, np.cumsum(gain[:, j]))
        before = run[first[:-1]][rows]
        drop = rows * 1e7
        low = np.minimum.accumulate(run[:-1] - before - drop)
        here = run[1:] - before - drop - low
        if len(here):
            np.maximum(most, np.where(n > 0, np.maximum.reduceat(here, begin), 0), out=most)
    open_texts = np.flatnonzero((most >= switch / 2 - 1e-3) & (n > 1))
    if not len(open_texts):
        return label
    order = open_texts[np.argsort(-n[open_texts], kind="stable")]
    length = n[order]
    value = np.zeros((len(order), k))
    came = np.zeros(score.shape, np.int16)
    own = np.arange(k)
    for t in range(length[0]):
        a = int(np.searchsorted(-length, -t, "left"))
        at = first[order[:a]] + t
        v = value[:a]
        top = v.max(1)
        moved = v < (top - switch)[:, None]
        came[at] = np.where(moved, v.argmax(1)[:, None], own)
        value[:a] = np.where(moved, (top - switch)[:, None], v) + score[at]
    state = value.argmax(1)
    for t in range(length[0] - 1, -1, -1):
        a = int(np.searchsorted(-length, -t, "left"))
        at = first[order[:a]] + t
        label[at] = state[:a]
        state[:a] = came[at, state[:a]]
    return label


_RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))),
    ]
)


def _labelled(model: Model, texts: pa.Array, switch: float, spans: bool) -> pa.Array:
    pred, share, found = [], [], []
    for c in textscan.chunks(texts):
        s, e, first, word = _words(c)
        if not len(s) or not model.langs:
            pred += ["und"] * c.n
            share += [0.0] * c.n
            found += [[]] * c.n
            continue
        score, counts = model.scores(c, s, e, word)
        label = viterbi(score, first, switch)
        rows = np.repeat(np.arange(c.n), np.diff(first))
        weight = np.where(counts, e - s, 0)
        by = np.bincount(rows * len(model.langs) + label, weight, c.n * len(model.langs)).reshape(c.n, -1)
        all_of, best = by.sum(1), by.argmax(1)
        letters = np.zeros(c.n, bool)
        letters[rows[counts]] = True
        for i in np.flatnonzero(~letters):  # no word counts: is there a letter at all?
            letters[i] = any(map(str.isalpha, c.data[c.offsets[i] : c.offsets[i + 1]].tobytes().decode("utf-8", "replace")))
        best = np.where(all_of > 0, best, model.prior)
        pred += [model.langs[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
        share += np.where(letters & (all_of > 0), by.max(1) / np.maximum(1, all_of), 0.0).tolist()
        if not spans:
            found += [[]] * c.n
            continue
        points = np.append(0, np.cumsum((c.data & 0xC0) != 0x80))
        base = points[c.offsets[:-1]]
        use = np.flatnonzero(counts)
        change = np.append(True, (label[use][1:] != label[use][:-1]) | (rows[use][1:] != rows[use][:-1]))[: len(use)]
        start = np.flatnonzero(change)
        end = np.append(start[1:], len(use)) - 1
        each: list[list] = [[] for _ in range(c.n)]
        for a, b in zip(use[start], use[end], strict=True) if len(use) else ():
            i = rows[a]
            each[i].append({"start": int(points[s[a]] - base[i]), "end": int(points[e[b]] - base[i]), "lang": model.langs[label[a]]})
        found += each
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))])
    return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(found, kind.field("spans").type)], fields=list(kind))


def learn(docs: DataFrame, learns: Column) -> Model:
    """The model of the rows of docs with a lang for which learns holds. Its
    size is bounded by the number of languages: 2**17 buckets each."""
    labelled = docs.where(learns & F.col("lang").isNotNull()).select("text", "lang")
    langs = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    if not langs:
        return Model([], *[np.zeros(0, np.int64)] * 3)
    t = labelled.mapInArrow(_counts(langs), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    return Model(langs, *(t[c].to_numpy() for c in ("lang", "bucket", "n")))


def identify(docs: DataFrame, learns: Column, switch: float = SWITCH, spans: bool = True, name: str = "language") -> DataFrame:
    """docs with a column of the given name: its lang_pred, score (the share of its labelled
    bytes in that language) and spans (code points, end exclusive).

    A text that is null, or without a letter, is `und` with score 0, and so is
    every text if no row has a lang to learn. A text whose scripts no learned
    language has gets the most frequent language with score 0. Of languages
    with equally many bytes the first in alphabetical order is predicted. A
    text of any length is labelled whole. Repeated rows are labelled each; an empty table
    gives an empty result; a column of docs of that name is replaced.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs, learns))
    return docs.withColumn(name, _udf(sent, switch, spans)(F.coalesce("text", F.lit(""))))


def _udf(sent, switch: float, spans: bool):
    @F.arrow_udf(_RESULT)
    def label(texts: pa.Array) -> pa.Array:
        return _labelled(sent.value, pc.fill_null(texts, ""), switch, spans)

    return label


def remainder(modulus: int) -> Column:
    """crc32 of doc_id as text, by modulus; -1 for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = identify(docs, remainder(4) != 2)
    spans = F.transform("language.spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["lang"]))
    return labelled.select(
        "doc_id",
        (remainder(4) == 2).alias("held_out"),
        F.col("language.lang_pred").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.size(spans).cast("long").alias("n_spans"),
        F.array_join(spans, ",").alias("spans"),
    )
