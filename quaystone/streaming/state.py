"""Stateful operators over time, as Structured Streaming.

The state machines are plain functions of a key's state and one event, so the
batch form (a sorted pass that holds one state at a time) and the stream form
(applyInPandasWithState) share them and tests can drive them with a clock.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Machine = Callable[[dict, float], tuple]


def limiter(limit: int, seconds: float) -> Machine:
    """Accepts an event unless limit were accepted in the seconds before it;
    refused ones are not counted. Gives (accepted, accepted before it)."""

    def step(state: dict, at: float, _value=None) -> tuple:
        kept = [t for t in state.get("times", []) if at - t < seconds]
        accepted = len(kept) < limit
        before = len(kept)
        if accepted:
            kept.append(at)
        state["times"] = kept
        return accepted, before

    return step


def breaker(failures: int, cooldown: float) -> Machine:
    """closed, and open after so many failures in a row; once cooled down it
    lets calls through again: a failure then opens it anew, a success closes
    it. Events (failed) that meet an open breaker are not tried. Gives (tried,
    open or closed after)."""

    def step(state: dict, at: float, failed=False) -> tuple:
        opened = state.get("opened")
        if opened is not None and at - opened < cooldown:
            return False, "open"
        if failed:
            state["count"] = state.get("count", 0) + 1
            if opened is not None or state["count"] >= failures:
                state["opened"] = at
                return True, "open"
            return True, "closed"
        state["count"], state["opened"] = 0, None
        return True, "closed"

    return step


def suppressor(per_title: int, seconds: float) -> Machine:
    """Of one title: an address passes once in the window, and so many
    addresses in all; the next that passes carries the number held back.
    Events (address, or a struct of address and own: one that is its own
    report is not held to the number of addresses). Gives (passed, held
    back)."""

    def step(state: dict, at: float, address=None) -> tuple:
        own = isinstance(address, dict) and bool(address.get("own"))
        address = address.get("address") if isinstance(address, dict) else address
        recent = [(t, a) for t, a in state.get("passed", []) if at - t < seconds]
        passes = (own or len(recent) < per_title) and all(a != address for _, a in recent)
        if not passes:
            state["passed"], state["held"] = recent, state.get("held", 0) + 1
            return False, 0
        held, state["held"] = state.get("held", 0), 0
        state["passed"] = [*recent, (at, address)]
        return True, held

    return step


def give_up(after: int) -> Machine:
    """Counts failures of a message. Events (failed). Gives (given up now,
    failures)."""

    def step(state: dict, _at: float, failed=False) -> tuple:
        state["n"] = state.get("n", 0) + bool(failed)
        return bool(failed) and state["n"] == after, state["n"]

    return step


def store(seconds: float, most: int) -> Machine:
    """Keeps a key for so many seconds after its last use, and the most
    recently used keys only. Events (key). Gives (was held, keys held after)."""

    def step(state: dict, at: float, key=None) -> tuple:
        held = state.setdefault("held", {})  # in order of last use
        used = held.pop(key, None)
        held[key] = at
        old = [k for i, (k, t) in enumerate(held.items()) if at - t > seconds or i < len(held) - most]
        known = used is not None and at - used <= seconds
        for k in old:
            del held[k]
        return known, len(held)

    return step


#: A table of callers past so many times its cap after a sweep is emptied.
FLOOD = 5


def tracked_limiter(limit: int, seconds: float, cap: int) -> Machine:
    """A limiter over all callers of a table. Events (caller). A caller is
    refused if limit of its requests were accepted in the seconds before, those
    exactly so long ago included. With more than cap callers, and at most once
    in so many seconds, those are forgotten whose last request is longer ago;
    a table that is then still past FLOOD times cap is emptied. Gives
    (accepted, callers held after)."""

    def step(state: dict, at: float, caller=None) -> tuple:
        seen = state.setdefault("seen", {})
        if len(seen) > cap and at - state.get("swept", float("-inf")) >= seconds:
            state["swept"] = at
            for idle in [k for k, times in seen.items() if not times or at - times[-1] > seconds]:
                del seen[idle]
            if len(seen) > cap * FLOOD:
                seen.clear()
        times = [t for t in seen.get(caller, ()) if at - t <= seconds]
        accepted = len(times) < limit
        seen[caller] = [*times, at] if accepted else times
        return accepted, len(seen)

    return step


def _schema(events: DataFrame, id_column: str, key: str, names: tuple[str, str], kinds: tuple[str, str]) -> str:
    of = lambda c: f"`{c}` {events.schema[c].dataType.simpleString()}"
    return f"{of(id_column)}, {of(key)}, {names[0]} {kinds[0]}, {names[1]} {kinds[1]}"


def _stepped(machine: Machine, state: dict, at: float, value, valued: bool) -> tuple:
    return machine(state, at, value) if valued else machine(state, at)


def replay(events: DataFrame, key: str, at: str, value: str | None, id_column: str, machine: Machine, names: tuple[str, str], kinds: tuple[str, str]) -> DataFrame:
    """The machine over each key's events in order of time and id: id, key and
    the machine's two results. Keys are dealt and sorted, and a task goes
    through its rows batch by batch with the state of one key, so no history of
    a key is held, however long it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), {}
        for pdf in batches:
            values = pdf["_value"] if value else [None] * len(pdf)
            out = []
            for k, missing, t, v in zip(pdf[key], pdf[key].isna(), pdf["_at"], values, strict=True):
                k = None if missing else k
                if k != current:
                    current, state = k, {}
                out.append(_stepped(machine, state, t, v, bool(value)))
            yield pd.DataFrame({id_column: pdf[id_column], key: pdf[key], names[0]: [x[0] for x in out], names[1]: [x[1] for x in out]})

    slim = events.select(id_column, key, seconds_of(F.col(at)).alias("_at"), *([F.col(value).alias("_value")] if value else []))
    return slim.repartition(key).sortWithinPartitions(key, "_at", id_column).mapInPandas(run, _schema(events, id_column, key, names, kinds))


def seconds_of(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")) / 1e6


def replay_stream(
    events: DataFrame, key: str, at: str, value: str | None, id_column: str, machine: Machine, names: tuple[str, str], kinds: tuple[str, str], idle: str = "24 hours", delay: str = "24 hours",
) -> DataFrame:
    """The stream form of replay, for any of the machines: their state is kept
    as JSON. Events later than delay are dropped. A key whose last event the
    watermark has passed by idle is forgotten; time is the events' own, so a
    replay gives what the live stream gave."""
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(group_key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, last = state.get if state.exists else ("{}", 0.0)
        held = json.loads(held)
        pdf = pd.concat(list(batches)).sort_values(["_at", id_column])
        values = pdf["_value"] if value else [None] * len(pdf)
        out = [_stepped(machine, held, t, v, bool(value)) for t, v in zip(pdf["_at"], values, strict=True)]
        last = max(last, float(pdf["_at"].max()))
        state.update((json.dumps(held), last))
        state.setTimeoutTimestamp(max(int(last * 1000) + ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({id_column: pdf[id_column].to_numpy(), key: group_key[0], names[0]: [x[0] for x in out], names[1]: [x[1] for x in out]})

    wanted = [id_column, key, F.col(at).cast("timestamp").alias("_ts"), *([F.col(value).alias("_value")] if value else [])]
    stamped = events.select(*wanted).withWatermark("_ts", delay).withColumn("_at", seconds_of(F.col("_ts")))
    return stamped.groupBy(key).applyInPandasWithState(run, _schema(events, id_column, key, names, kinds), "held string, last double", "append", GroupStateTimeout.EventTimeTimeout)


def once(messages: DataFrame, id_column: str, at: str, delay: str = "14 days") -> DataFrame:
    """Each message once, however often a poll lists it; ids are held for as
    long as a poll looks back."""
    stamped = messages.withColumn(at, F.col(at).cast("timestamp"))
    return stamped.withWatermark(at, delay).dropDuplicatesWithinWatermark([id_column])


def sliding_count(events: DataFrame, key: str, at: str, interval: str) -> DataFrame:
    """events with recent: how many of its key fall in the interval that ends
    with it, itself included."""
    seconds = int(pd.Timedelta(interval).total_seconds() * 1_000_000)
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds, 0)
    return events.withColumn("recent", F.count("*").over(w))


def runs(events: DataFrame, key: str, at: str, id_column: str, is_failure: Column) -> DataFrame:
    """key, length, first and last id of each run of failures in a row."""
    w = Window.partitionBy(key).orderBy(at, id_column)
    tagged = events.withColumn("_f", is_failure).withColumn("_g", F.sum(F.when(F.col("_f"), 0).otherwise(1)).over(w))
    return tagged.where("_f").groupBy(key, "_g").agg(F.count("*").alias("length"), F.min_by(id_column, F.struct(at, id_column)).alias("first_id"), F.max_by(id_column, F.struct(at, id_column)).alias("last_id")).drop("_g")
