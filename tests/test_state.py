"""State machines with a clock, and their streams."""

import json

import pytest
from pyspark.sql import functions as F

from quaystone.operators import pairing, retrieval
from quaystone.streaming import mailbox, run, state


def drive(machine, events):
    held: dict = {}
    return [machine(held, *e) for e in events]


def test_limiter_forgets_refused_events():
    got = drive(state.limiter(2, 60), [(0,), (1,), (2,), (59,), (60,), (61,), (62,)])
    assert [x[0] for x in got] == [True, True, False, False, True, True, False]


def test_breaker_opens_cools_and_reopens():
    got = drive(state.breaker(3, 60), [(0, True), (1, True), (2, True), (10, False), (62, True), (63, False), (130, False), (131, True)])
    assert got == [(True, "closed"), (True, "closed"), (True, "open"), (False, "open"), (True, "open"), (False, "open"), (True, "closed"), (True, "closed")]


def test_suppressor_counts_what_it_held_back():
    events = [(i, f"m{i}") for i in range(5)] + [(5, "m0"), (700, "m9")]
    got = drive(state.suppressor(3, 600), events)
    assert [x[0] for x in got] == [True, True, True, False, False, False, True] and got[-1][1] == 3


def test_give_up_once():
    assert [x[0] for x in drive(state.give_up(2), [(0, True), (1, False), (2, True), (3, True)])] == [False, False, True, False]


def test_store_forgets_by_age_and_by_use():
    got = drive(state.store(10, 2), [(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, "b"), (14, "b"), (25, "b"), (36, "c")])
    assert got == [(False, 1), (False, 2), (True, 2), (False, 2), (False, 2), (True, 1), (False, 1), (False, 1)]


MACHINES = {
    "limiter": (None, state.limiter(2, 86400.0), ("accepted", "before"), ("boolean", "long")),
    "breaker": ("failed", state.breaker(2, 3 * 86400.0), ("tried", "after"), ("boolean", "string")),
    "suppressor": ("event_type", state.suppressor(1, 7 * 86400.0), ("passed", "held_back"), ("boolean", "long")),
    "give_up": ("failed", state.give_up(2), ("given_up", "failures"), ("boolean", "long")),
    "store": ("event_type", state.store(7 * 86400.0, 2), ("hit", "held"), ("boolean", "long")),
}


@pytest.mark.parametrize("name", MACHINES)
def test_streams_give_what_replay_gives(spark, data, name):
    value, machine, names, kinds = MACHINES[name]
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    tagged = lambda df: df.withColumn("failed", F.col("event_type") == "error")
    stream = tagged(spark.readStream.schema(schema).parquet(f"{data}/events.parquet*"))
    streamed = run.to_table(state.replay_stream(stream, "user_id", "ts", value, "event_id", machine, names, kinds))
    batch = state.replay(tagged(spark.read.parquet(f"{data}/events.parquet")), "user_id", "ts", value, "event_id", machine, names, kinds)
    rows = lambda df: sorted(tuple(r[c] for c in ("event_id", "user_id", *names)) for r in df.collect())
    assert rows(streamed) == rows(batch) and len(rows(batch)) == spark.read.parquet(f"{data}/events.parquet").count()


def test_once(spark, data):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{data}/events.parquet*")
    twice = stream.unionByName(spark.readStream.schema(schema).parquet(f"{data}/events.parquet*"))
    assert run.to_table(state.once(twice, "event_id", "ts", "60 days")).count() == spark.read.parquet(f"{data}/events.parquet").count()


def test_a_long_history_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    events = spark.range(1000).selectExpr("id", "if(id < 900, 1, null) as k", "timestamp_seconds(id) as at")
    got = state.replay(events, "k", "at", None, "id", state.limiter(1, 10), ("ok", "before"), ("boolean", "long")).where("ok").groupBy("k").count().collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["k"]: r["count"] for r in got} == {1: 90, None: 10}


def test_own_reports_are_held_to_their_address_only():
    events = [(i, {"address": f"m{i}", "own": True}) for i in range(5)] + [(6, {"address": "m0", "own": True})]
    assert [x[0] for x in drive(state.suppressor(3, 600), events)] == [True] * 5 + [False]


def test_batches_are_appended_once(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{data}/events.parquet*")
    run.append_batches(stream.select("event_id"), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == spark.read.parquet(f"{data}/events.parquet").count()


def test_mailbox_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "files").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"m{i}.json").write_text(json.dumps({"email_id": f"m{i % 2}", "from": "a@b.example", "subject": "s", "body": "the invoice", "attachments": [], "at": f"2024-01-0{i + 1}T00:00:00"}))
    mailbox.watch(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/files", f"file://{tmp_path}/out")
    assert sorted((r["email_id"], r["category"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [("m0", "INVOICE_QUERY"), ("m1", "INVOICE_QUERY")]


def test_requests_close_on_later_answers_only(spark):
    rows = [("d", "r", 5), ("d", "r", 9), ("e", "r", 1)]
    requests = spark.createDataFrame(rows, "domain string, ref string, at int")
    answers = spark.createDataFrame([("d", "r", 5), ("d", "r", 7), ("e", "other", 3)], "domain string, ref string, at int")
    got = {(r["domain"], r["at"]): r["closed_at"] for r in pairing.close_requests(requests, answers).collect()}
    assert got == {("d", 5): 7, ("d", 9): None, ("e", 1): None}


def test_upsert_twice_changes_nothing(spark):
    rows = lambda *x: retrieval.with_hash(spark.createDataFrame(list(x), "source string, content string"))
    stored = rows(("a", "1"), ("a", "2"), ("b", "3"))
    once = retrieval.upsert(stored, rows(("a", "2"), ("a", "4")))
    key = lambda df: sorted((r["source"], r["content"]) for r in df.collect())
    assert key(once) == [("a", "2"), ("a", "4"), ("b", "3")] == key(retrieval.upsert(once, rows(("a", "2"), ("a", "4"))))
