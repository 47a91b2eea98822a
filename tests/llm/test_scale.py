"""Shards recomputed from a plan by plain Python, many benchmark blocks over
many batches, tokens settled early, and the pipeline against plain stages."""

import bisect
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quaystone.llm import decontaminate, mixing, ngram_join, sharding, warc
from quaystone.llm.shared import written
from quaystone.session import table


def by_plan(rows: list, plan, n_shards: int) -> dict:
    """Shard and slot of each (h, d, size, n), from cumulative sizes in the plan's order."""
    bounds = list(zip(plan.hashes.tolist(), plan.ids.tolist(), strict=True))
    ranges = [[] for _ in range(len(bounds) + 1)]
    for row in rows:
        ranges[bisect.bisect_right(bounds, row[:2])].append(row)
    total, before, out, slots = sum(r[2] for r in rows), 0, {}, Counter()
    for held in ranges:
        size = sum(r[2] for r in held)
        shard = min(n_shards - 1, math.floor((before + size / 2) * n_shards / max(1, total)))
        for row in sorted(held):
            out[row[3]] = (shard, slots[shard])
            slots[shard] += 1
        before += size
    return out


@pytest.mark.parametrize(("coarse", "rows_a_range"), [(4096, 200_000), (8, 40)])
def test_shards_are_those_of_the_plan(spark, monkeypatch, coarse, rows_a_range):
    monkeypatch.setattr(sharding, "COARSE", coarse)
    monkeypatch.setattr(sharding, "ROWS_A_RANGE", rows_a_range)
    texts = spark.range(6000).selectExpr("if(id % 50 = 0, null, id) as doc_id", "if(id % 7 = 0, 'hot text', if(id % 11 = 0, null, repeat(cast(id as string), 1 + cast(id % 90 as int)))) as text")
    keys = written(sharding.keyed(texts).drop("text"), "keys")
    plan = sharding.plan_shards(keys, 8)
    assert not plan.splits_rows() or plan.pieces.max() > 1
    rows = [tuple(r) for r in keys.select("_h", "_d", "_size", "_n").collect()]
    if not plan.splits_rows():
        got = {r["n"]: (r["shard"], r["slot"]) for r in sharding.assign(keys.withColumn("n", F.col("_n")), plan).collect()}
        assert got == by_plan(rows, plan, 8)
    sizes = Counter()
    for r in sharding.assign(keys.withColumn("size", F.col("_size")), plan).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) < 1.05 * min(sizes.values())
    # texts whose group is no larger than a range stay together
    goal = sum(r[2] for r in rows) / max(8 * sharding.RANGES_A_SHARD, len(rows) // rows_a_range)
    group = Counter()
    for h, _, size, _ in rows:
        group[h] += size
    inside = {h for h, d in zip(plan.hashes.tolist(), plan.ids.tolist(), strict=True) if d != sharding.LEAST}
    assert all(group[h] > goal / 2 for h in inside)


def test_more_blocks_than_a_worker_keeps(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 256)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(60)]
    docs = [(i, f"some words before {items[i % 60][1]} and some after" if i % 3 else f"clean text number {i} of many words here") for i in range(400)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    held = decontaminate.Benchmark(benchmark)
    assert held.n_blocks > decontaminate.KEPT
    want = sorted((i, i % 60) for i, _ in docs if i % 3)
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, benchmark).collect()) == want
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(df, benchmark).collect()) == [i for i, _ in docs if i % 3 == 0]
    reads = Counter()
    kept = decontaminate._block
    monkeypatch.setattr(decontaminate, "_block", lambda folder, b: (reads.update([b]), kept(folder, b))[1])
    batches = [(pa.array([i]), pa.array([t])) for i, t in docs]
    found = [len(hits) for _, hits in decontaminate._searched(held.folder, held.n_blocks, iter(batches))]
    assert found == [int(i % 3 > 0) for i, _ in docs] and set(reads.values()) == {1}


def test_tokens_settled_early_tell_the_same(monkeypatch):
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 400, 60)).astype(np.uint64) << np.uint64(16) for _ in range(300)]
    sigs = [int(x) for x in r.integers(1, 2**60, 300)]

    def told(settle: int) -> dict:
        monkeypatch.setattr(ngram_join, "SETTLE", settle)
        rows = []
        for at in range(0, 300, 10):  # each flush has few sets, so no token is hot in one
            tok = np.concatenate([x >> np.uint64(16) for x in sets[at : at + 10]])
            n = np.array([len(x) for x in sets[at : at + 10]])
            rows.append(ngram_join._rows([0], [0], [ngram_join._pack48(tok)], [np.array(sigs[at : at + 10], np.int64).tobytes()], [n.astype("<u2").tobytes()], [b""]))
        held: dict = {}
        for batch in ngram_join._counted(3)(iter(rows)):
            for a, b, c in zip(*[batch[x].to_pylist() for x in "abc"], strict=True):
                for sig, tok, df in zip(np.frombuffer(a, "<i8").tolist(), ngram_join._unpack48([b]).tolist(), np.frombuffer(c, "u1").tolist(), strict=True):
                    assert held.setdefault((sig, tok), df) == df
        return held

    # kinds 0 list tokens by set, so the tokens of a row belong to the sets in turn
    assert told(10**9) == told(500) and max(told(500).values()) == ngram_join.HOT


def test_archives_without_a_path(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example", "<p>x</p>")], "page_id long, url string, html string")
    files = warc.write_warc(pages, f"file://{tmp_path}/warc").select("path", "bytes")
    odd = files.unionByName(files).unionByName(spark.createDataFrame([(None, 5), ("file:/none", None)], files.schema))
    assert warc.read_warc(odd).count() == 2


WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_near_duplicates(docs):
    sets = [shingles(t) for _, t, _ in docs]
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                if x != y:
                    root = [min(x, y) if r in (x, y) else r for r in root]
    best = {}
    for i, r in enumerate(root):
        if not sets[i]:
            best["alone", i] = i
        elif r not in best or docs[i][0] < docs[best[r]][0]:
            best[r] = i
    return [docs[i] for i in sorted(best.values())]


def plain_mixture(docs):
    size = Counter()
    for _, text, source in docs:
        size[source or ""] += len((text or "").encode()) + 1
    weights = {s: b**mixing.TEMPER for s, b in size.items()}
    out = []
    for doc in docs:
        s = doc[2] or ""
        rate = weights[s] / sum(weights.values()) * sum(size.values()) / size[s]
        u = int(hashlib.md5(f"{mixing.SEED}:{doc[0]}".encode()).hexdigest()[:13], 16) / 2**52
        cdf, k, p = 0.0, 0, math.exp(-rate)
        while True:
            cdf += p
            if cdf > u:
                break
            k += 1
            p *= rate / k
        out += [doc] * k
    return out


def test_pipeline_is_its_plain_stages(spark, data):
    docs = table(spark, data, "documents")
    first = corpus_pipeline.language_id(spark, docs, data)
    rows = [tuple(r) for r in first.select("doc_id", "text", "source").collect()]
    items = [shingles(r["text"]) for r in table(spark, data, "benchmark").collect()]
    kept = [d for d in plain_near_duplicates(rows) if not any(q and 100 * len(q & shingles(d[1])) >= 80 * len(q) for q in items)]
    want = Counter(d[0] for d in plain_mixture(kept))
    done = corpus_pipeline.run(spark, data).collect()
    assert Counter(r["doc_id"] for r in done) == want and want
    by_shard = {}
    for r in done:
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    text = {d[0]: d[1] for d in rows}
    assert all(r["text"] == text[r["doc_id"]] for r in done)
