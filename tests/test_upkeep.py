"""Batches that fail, are stopped and taken up again; tables on disk whose other
buckets stay; chunks against string recursion; contracts of maps."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quaystone.functions import chunking
from quaystone.operators import batch, buckets, contracts, extraction, ledger, retrieval


def failing(text):
    raise ValueError("down")


def test_batches_that_fail_and_are_taken_up(spark, tmp_path):
    at = f"file://{tmp_path}/b"
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d"), (4, "c"), (None, "x")], "k long, p string")
    boom = lambda text: (_ for _ in ()).throw(ValueError("down"))
    counts = lambda model, n=None: tuple(batch.run(rows, "k", "p", model, at, n).first())
    held = lambda: {r["k"]: (r["answer"], r["run"]) for r in batch.answers(spark, at, "k", "long").collect()}
    assert counts(boom) == (0, 0, 4) and counts(boom, 2) == (0, 0, 4) and held() == {}
    assert {r["k"]: (r["error"], r["tries"]) for r in batch.failures(spark, at, "k", "long").collect()} == {1: ("ValueError: down", 2), 2: ("ValueError: down", 2), 3: ("no prompt", 2), 4: ("ValueError: down", 2)}
    assert counts(lambda t: t.upper() if t != "b" else None) == (2, 0, 2) and held() == {1: ("A", 3), 4: ("C", 3)}
    assert counts(lambda t: t + t) == (1, 2, 1) and held() == {1: ("A", 3), 2: ("bb", 4), 4: ("C", 3)}
    assert [tuple(r) for r in batch.runs(spark, at).collect()] == [(1, True, 0, 0, 4), (2, True, 0, 0, 4), (3, True, 2, 0, 2), (4, True, 1, 2, 1)]
    assert counts(lambda t: "never") == (0, 3, 1)
    assert tuple(batch.run(rows.limit(0), "k", "p", boom, f"file://{tmp_path}/none").first()) == (0, 0, 0)


def test_a_batch_that_is_stopped_keeps_what_it_had(spark, tmp_path):
    at = f"file://{tmp_path}/b"
    rows = spark.range(8).selectExpr("id as k", "string(id) as p").repartitionByRange(8, "k")

    def stops(text):
        if text == "7":
            import os

            time.sleep(3)  # others are done by then
            os._exit(1)  # the worker dies, and with it the run
        return "first"

    with pytest.raises(Exception, match="(?s)."):
        batch.run(rows, "k", "p", stops, at, 8)
    before = {r["k"] for r in batch.answers(spark, at, "k", "bigint").collect()}
    assert before and 7 not in before
    done, skipped, failed = batch.run(rows, "k", "p", lambda t: "second", at).first()
    assert (done, skipped, failed) == (8 - len(before), len(before), 0)
    assert {r["k"]: r["answer"] for r in batch.answers(spark, at, "k", "bigint").collect()} == {k: "first" if k in before else "second" for k in range(8)}
    assert [(r["run"], r["ended"]) for r in batch.runs(spark, at).collect()] == [(1, False), (2, True)]


def test_a_store_by_text(spark, tmp_path):
    at = f"file://{tmp_path}/c"
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "n int, t string")
    assert {r["n"]: r["answer"] for r in batch.remembered(rows, "t", lambda t: t + "1", at).collect()} == {1: "x1", 2: "x1", 3: "y1", 4: None}
    assert {r["n"]: r["answer"] for r in batch.remembered(rows, "t", lambda t: t + "2", at).collect()} == {1: "x1", 2: "x1", 3: "y1", 4: None}


def test_small_listings(spark):
    mails = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "email_id string, n int")
    ids = lambda df: [r[0] for r in df.collect()]
    assert ids(batch.in_order(mails)) == ["a", "b", "c"] and ids(batch.newest(mails, 2)) == ["c", "b"] and ids(batch.by_id(mails, "b")) == ["b"]
    assert ids(batch.in_order(mails, "n")) == ["b", "a", "c"] and sorted(ids(batch.shared_keys(mails, mails.where("n > 1"), "email_id"))) == ["a", "c"]
    assert [tuple(r) for r in batch.tally(spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "v string"), "v").collect()] == [("x", 2), (None, 1), ("y", 1)]
    rows = "array<struct<field:string,verdict:string>>"
    shown = spark.createDataFrame([("a", [("f", "match")], "s", "b"), ("b", [], "s", "b"), ("c", None, "s", "b"), ("d", [("f", "match")], None, "b")], f"email_id string, rows {rows}, si_path string, bl_path string")
    assert ids(batch.comparable(shown)) == ["a"]


def test_offenders_are_bounded_and_listed(spark):
    trials = spark.range(1000).selectExpr("id", "if(id % 3 = 0, null, id % 3) as g", "if(id = 7, null, id % 10 <> 0) as ok")
    got = {r["g"]: (r["trials"], r["held"], r["missed"]) for r in batch.offenders(trials, ["g"], F.col("ok"), "id", 3).collect()}
    assert got == {None: (334, 300, [0, 30, 60]), 1: (333, 299, [7, 10, 40]), 2: (333, 300, [20, 50, 80])}


def files(path):
    return {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet") if "manifest" not in str(p)}


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    kept = buckets.Buckets(spark, f"file://{tmp_path}/t", "k long, v string, at int", ["k"], 8)
    make = lambda *rows: spark.createDataFrame(list(rows), "k long, v string, at int")
    held = lambda: sorted(tuple(r) for r in kept.read().collect())
    assert held() == [] and kept.upsert(make(), "at") == 0
    kept.upsert(spark.range(200).selectExpr("id as k", "'old' as v", "0 as at"), "at")
    before = files(tmp_path / "t")
    assert kept.upsert(make((3, "b", 1), (3, "a", 1), (3, "z", 0), (500, "new", 1)), "at") <= 2
    assert held() == sorted([(k, "old", 0) for k in range(200) if k != 3] + [(3, "b", 1), (500, "new", 1)])
    after = files(tmp_path / "t")
    assert all(after[p] == t for p, t in before.items()) and 0 < len(after) - len(before) <= 2
    older = buckets.Buckets(spark, f"file://{tmp_path}/t", "k long, v string, at int", ["k"], 8)
    kept.changed(make((3, "gone", 0)), lambda stored, new: stored.join(new.select("k"), "k", "left_anti"))
    assert 3 not in {r["k"] for r in older.read().collect()} and kept.read().count() == 200


def test_a_change_that_dies_is_none(spark, tmp_path):
    kept = buckets.Buckets(spark, f"file://{tmp_path}/t", "k long, v string", ["k"], 4)
    make = lambda *rows: spark.createDataFrame(list(rows), "k long, v string")
    kept.replace(make((1, "a"), (1, "b"), (2, "c")))

    def dies(stored, new):
        return stored.unionByName(new.withColumn("v", F.raise_error(F.lit("stop"))))

    with pytest.raises(Exception, match="stop"):
        kept.changed(make((1, "x")), dies)
    assert sorted(tuple(r) for r in kept.read().collect()) == [(1, "a"), (1, "b"), (2, "c")]
    kept.replace(make((1, "z")))
    kept.append(make((2, "c")))
    assert sorted(tuple(r) for r in kept.read().collect()) == [(1, "z"), (2, "c"), (2, "c")]


def test_corrections_on_disk(spark, tmp_path):
    reviews = buckets.Buckets(spark, f"file://{tmp_path}/reviews", "user_id string, email_ref string, source string, mark string, updated_at int", ["user_id", "email_ref"], 4)
    schema = "user_id string, email_ref string, source string, mark string, field string, was string, corrected string, kind string, side string, title string, at int"
    fresh = spark.createDataFrame([("u", "e1", "demo", None, "shipper", "A", "B", "fix", "SI", "fixed shipper", 1), ("u", "e1", "demo", None, "pod", "C", "D", "confirm", None, None, 2)], schema)
    ledger.record_corrections(reviews, f"file://{tmp_path}/reports", f"file://{tmp_path}/corrections", fresh)
    ledger.record_corrections(reviews, f"file://{tmp_path}/reports", f"file://{tmp_path}/corrections", fresh.withColumn("at", F.lit(5)))
    assert [tuple(r) for r in reviews.read().collect()] == [("u", "e1", "demo", None, 5)]
    assert spark.read.parquet(f"file://{tmp_path}/reports").count() == 2 and spark.read.parquet(f"file://{tmp_path}/corrections").count() == 4
    sent = spark.createDataFrame([("u", "problem", "e1", "bad", 2, 1), ("u", None, None, None, None, 2), (None, "problem", "e1", "x", 1, 3), ("v", "idea", " ", "m", 5, 4)], "user_id string, kind string, about string, msg string, rating int, at int")
    assert [(r["title"], r["detail"], r["kind"]) for r in ledger.filed_reports(sent).orderBy("created_at").collect()] == [("problem on e1", "bad", "human"), ("note", "", "human"), ("idea", "m", "human")]


def test_equally_late_rows_have_one_winner(spark):
    stored = spark.createDataFrame([("a", "old", 0)], "k string, v string, at int")
    fresh = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("a", None, 1)], "k string, v string, at int").repartition(3)
    assert [tuple(r) for r in ledger.upserted(stored, fresh, ["k"], "at").collect()] == [("a", "y", 1)]


def by_strings(text, size, overlap, separators=("\n\n", "\n", " ", "")):
    """The same cuts by recursion over strings, one piece at a time."""
    n = next(i for i, s in enumerate(separators) if s == "" or s in text)
    head, *tail = text.split(separators[n]) if separators[n] else (list(text) or [""])
    pieces = [x for x in [head, *[separators[n] + t for t in tail]] if x]
    out, short = [], []

    def gather():
        window: list[str] = []
        for piece in short:
            if sum(map(len, window)) + len(piece) > size and window:
                out.append("".join(window).strip())
                while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(piece) > size):
                    window.pop(0)
            window.append(piece)
        out.append("".join(window).strip())
        short.clear()

    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
            continue
        if short:
            gather()
        out += by_strings(piece, size, overlap, separators[n + 1 :]) if separators[n] else [piece]
    if short:
        gather()
    return [x for x in out if x]


def test_chunks_are_brute_force():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice(["a", "bb", "c" * r.randrange(1, 30), " ", "\n", "\n\n", "  ", "é"]) for _ in range(r.randrange(60)))
        size = r.randrange(2, 40)
        overlap = r.randrange(0, size)
        assert chunking.chunks_of(text, size, overlap) == list(dict.fromkeys(by_strings(text, size, overlap) if text else [])), (text, size, overlap)


@pytest.mark.parametrize("text", ["a" * 1_000_000, "a " * 500_000, "\n\n" * 500_000, ("x" * 1500 + "\n\n") * 700, " " * 1_000_000, "a\n" * 500_000, ("word " * 150 + "\n") * 1300])
def test_chunks_are_linear(text):
    began = time.perf_counter()
    found = chunking.chunks_of(text)
    assert time.perf_counter() - began < 2 and all(len(x) <= 1000 for x in found)


def test_documents_in_chunks(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], i): x for r in rows for i, x in enumerate(dict.fromkeys(by_strings(r["text"], 1000, 200) if r["text"] else []))}
    got = retrieval.indexed_chunks(spark.read.parquet(f"{data}/documents.parquet").select(F.col("doc_id").alias("source"), "text"))
    assert {(r["source"], r["chunk_index"]): r["content"] for r in got.collect()} == want
    odd = spark.createDataFrame([(None,), ("",), (" ",), ("x" * 10 + "y" * 10,)], "t string").select(chunking.chunks(F.col("t"), 10, 4).alias("c")).collect()
    assert [r["c"] for r in odd] == [None, [], [], ["x" * 10, "x" * 4 + "y" * 6, "y" * 8]]
    with pytest.raises(ValueError, match="overlap"):
        chunking.chunks(F.col("t"), 10, 10)


def test_contracts_of_maps_and_patterns(spark):
    schema = {"properties": {"m": {"type": "object", "required": ["a"], "properties": {"a": {"type": "number", "minimum": 1}}, "patternProperties": {"x_": {"type": ["number", "null"], "maximum": 5}, "x": {"maximum": 1}}, "additionalProperties": False}}}
    rows = spark.createDataFrame([({"a": 1, "x_1": 5},), ({"x_2": 6, "xy": 2, "b": 1},), ({"a": 0, "x_3": None},), (None,), ({},)], "m map<string,int>")
    assert [r["errors"] for r in contracts.validate(rows, schema).collect()] == [
        [], ["$.m: lacks a", "$.m: has unknown b", "$.m.x_2: is above 5", "$.m.xy: is above 1"], ["$.m.a: is below 1"], [], ["$.m: lacks a"],
    ]
    of_struct = {"patternProperties": {"x_": {"maximum": 5}}, "properties": {"a": {}}, "additionalProperties": False}
    rows = spark.createDataFrame([(1, 6, 7)], "a int, x_1 int, b int")
    assert contracts.validate(rows, of_struct).first()["errors"] == ["$.x_1: is above 5", "$: has unknown b"]


def test_scans_by_message(spark):
    readings = spark.createDataFrame([("e1_SI", ["a"]), ("e1_BL", ["b", "c"]), ("e1_BL", ["b"]), ("e2_BL", None), ("other", ["x"]), (None, ["x"])], "name string, untrusted array<string>")
    got = {r["email_id"]: (r["roles"], r["flagged"]) for r in extraction.scans(readings).collect()}
    assert got["e2"] == ("BL", 0) and got["e1"][0] == "BL+SI" and got["e1"][1] in (2, 3) and len(got) == 2


def test_a_report_is_one_file(spark, tmp_path):
    summary = spark.createDataFrame([(3, 0.5, None)], "n int, ok_share double, gone int")
    lines = ledger.report_lines(ledger.figures_of(summary, "B", {"n": "count", "ok_share": "right", "gone": "gone"}).unionByName(ledger.figures_of(summary, "A", {"n": "n"})))
    ledger.write_report(lines.repartition(5), f"file://{tmp_path}/report")
    (file,) = (tmp_path / "report").glob("*.txt")
    assert file.read_text() == "## A\n| figure | value |\n|---|---|\n| n | 3 |\n## B\n| figure | value |\n|---|---|\n| count | 3 |\n| right | 50.0% |\n| gone | n/a |\n"
