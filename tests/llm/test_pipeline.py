"""The pipeline's stages on nulls, repeated ids, clashing columns and empty tables."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

A, B, C, U, Z = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcuz")


def kept(df):
    return Counter(map(str, map(tuple, df.collect())))


def test_rows_are_kept_by_row_not_by_id(spark, data):
    rows = [(5, A), (9, A), (None, A), (5, B), (3, B + " tail"), (None, C), (None, C), (7, None), (None, ""), (8, "one of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(map(str, [(5, A), (3, B + " tail"), (None, C), (7, None), (None, ""), (8, "one of its own")]))
    assert kept(corpus_pipeline.near_duplicates(spark, docs, data)) == want


def test_no_text_is_lost_with_repeated_ids(spark, data):
    rows = [(1, B), (5, B), (5, U), (7, Z), (7, C), (None, B), (None, A), (None, A)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(map(str, [(1, B), (5, U), (7, Z), (7, C), (None, A)]))
    assert kept(corpus_pipeline.near_duplicates(spark, docs, data)) == want


@pytest.fixture
def odd(spark, data):
    """Documents with columns that the stages use themselves."""
    names = ("language", "_language", "row", "hash", "doc", "_row", "_key", "_copy", "_src", "_rate", "_doc", "_h", "_d", "_n", "_size", "found", "score")
    item = spark.read.parquet(f"{data}/benchmark.parquet").select("text").first()[0]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    more = spark.createDataFrame([(None, None, None, None, None), (7, item, "en", "src1", 3), (7, item, "en", "src1", 3), (None, "12 34", "en", None, 5), (8, "", None, "", 0)], docs.schema)
    return docs.union(more).withColumns({n: F.lit(i) for i, n in enumerate(names)})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_columns_and_stay_empty(spark, data, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    extra = {"shard", "slot"} if name == corpus_pipeline.STAGES[-1][0] else set()
    out = stage(spark, odd, data)
    assert set(out.columns) == set(odd.columns) | extra
    rows = out.collect()
    assert all(r["_language"] == 1 and r["_key"] == 6 and r["score"] == 16 for r in rows)
    texts = {r["text"] for r in odd.collect()}
    assert rows and {r["text"] for r in rows} <= texts
    empty = stage(spark, odd.limit(0), data)
    assert empty.count() == 0 and set(empty.columns) == set(out.columns)


def test_contaminated_rows_go_all_others_stay(spark, data, odd):
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))} if t and t.split() else set()
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    want = Counter((r["doc_id"], r["text"]) for r in odd.collect() if not any(q and len(q & shingles(r["text"])) >= 0.8 * len(q) for q in items))
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination(spark, odd, data).collect()) == want


def test_shards_hold_every_row(spark, data, odd):
    out = corpus_pipeline.sharded(spark, odd, data).select("doc_id", "text", "shard", "slot").collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter((r["doc_id"], r["text"]) for r in odd.collect())
    for s in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
