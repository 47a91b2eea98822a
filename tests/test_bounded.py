"""Bounded maps as state: streams against replays, sizes, sweeps and floods."""

from pyspark.sql import functions as F

from quaystone.session import shared_folder, table
from quaystone.streaming import bounded, run, state


def drive(machine, events):
    held = {}
    return [machine(held, at, who) for at, who in events], held


def test_callers_are_swept_and_floods_emptied():
    machine = state.tracked_limiter(2, 60, 3)
    out, held = drive(machine, [(0, "a"), (1, "a"), (60, "a"), (61, "a"), (61.5, "a"), (62, "b")])
    assert [x[0] for x in out] == [True, True, False, True, True, True] and out[-1][1] == 2
    # past the cap, the idle go once a window
    out, held = drive(machine, [(i, f"c{i}") for i in range(5)] + [(100, "x"), (101, "y"), (102, "z"), (103, "w"), (104, "v")])
    assert [n for _, n in out] == [1, 2, 3, 4, 5, 1, 2, 3, 4, 5]
    # active callers stay, until there are five times as many as the cap
    out, held = drive(machine, [(i * 0.1, f"f{i}") for i in range(30)] + [(60.45, "g"), (60.5, "h")])
    assert out[29][1] == 30 and out[30][1] == 1 and out[31][1] == 2 and len(held["seen"]) == 2
    out, held = drive(machine, [(i * 0.1, f"f{i}") for i in range(18)] + [(60.45, "g")])
    assert out[18][1] == 14


def events_of(spark, data):
    e = table(spark, data, "events").withColumn("who", F.concat(F.lit("c"), (F.col("event_id") % 23).cast("string"))).withColumn("part", F.col("user_id") % 3)
    at = shared_folder(spark, "events")
    for n in range(4):  # files in time order, so that a stream of one file a batch has several batches
        cut = [F.expr(f"ts >= timestamp '2024-01-01' + interval {n * 8} days"), F.expr(f"ts < timestamp '2024-01-01' + interval {(n + 1) * 8} days")]
        low, high = (F.lit(True) if n == 0 else cut[0]), (F.lit(True) if n == 3 else cut[1])
        e.where(low & high).coalesce(1).write.mode("append").parquet(at)
    return spark.read.parquet(at), spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(at)


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_the_store_streams_as_it_replays(spark, data):
    batch, stream = events_of(spark, data)
    names = ("hit", "held")
    want = state.replay(batch, "user_id", "ts", "event_type", "event_id", state.store(7 * 86400.0, 2), names, ("boolean", "long"))
    got = run.to_table(bounded.store(stream, "user_id", "ts", "event_type", "event_id", 7 * 86400.0, 2, delay="60 days"))
    assert rows(got) == rows(want) and got.agg(F.max("held")).first()[0] == 2


def test_callers_stream_as_they_replay(spark, data):
    batch, stream = events_of(spark, data)
    names = ("accepted", "tracked")
    want = state.replay(batch, "part", "ts", "who", "event_id", state.tracked_limiter(1, 40_000.0, 4), names, ("boolean", "long"))
    got = run.to_table(bounded.callers(stream, "part", "ts", "who", "event_id", 1, 40_000.0, 4, delay="60 days"))
    assert rows(got) == rows(want)
    most, refused = got.agg(F.max("tracked"), F.count_if(~F.col("accepted"))).first()
    assert 4 < most <= 4 * state.FLOOD + 23 and refused > 0


def test_state_holds_entries_not_histories(spark, data):
    _, stream = events_of(spark, data)
    out = bounded.store(stream, "part", "ts", "who", "event_id", 3 * 86400.0, 5, delay="1 days")
    at = shared_folder(spark, "stream")
    query = out.writeStream.format("memory").queryName("bounded_store_state").option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()
    held = query.lastProgress.stateOperators[0].numRowsTotal
    # three groups with five keys at most, a number and a timer each
    assert 0 < held <= 3 * (5 + 1 + 2) * 2
