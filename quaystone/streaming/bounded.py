"""Streams whose state is a bounded map: the store of recently used keys and
the table of callers.

The state of a group is a map in the state store, an entry a key, so a batch
writes the entries that it changed and no others; the machines of state.py run
over it, and a replay of the same events gives the same. An event-time timer
drops a group once it has been idle. Needs Spark's RocksDB state store
(spark.sql.streaming.stateStore.providerClass), which session.local_session
sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quaystone.streaming import state
from quaystone.streaming.state import Machine, seconds_of


class _Mapped(StatefulProcessor):
    """Runs a machine whose state is a map by text (part) and at most one
    number (mark)."""

    def __init__(self, machine: Machine, group: str, id_column: str, names: tuple[str, str], part: str, mark: str | None, idle: float):
        self.machine, self.group, self.id_column, self.names, self.part, self.mark, self.idle = machine, group, id_column, names, part, mark, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "times array<double>, place long")
        self.rest = handle.getValueState("rest", "mark double, place long")

    def _held(self) -> tuple[dict, dict, int]:
        """The machine's state, what is stored of it, and the next place."""
        stored = {k[0]: (tuple(v[0]), v[1]) for k, v in self.entries.iterator()} if self.entries.exists() else {}
        mark, place = self.rest.get() if self.rest.exists() else (None, 0)
        inner = {k: self._inner(times) for k, (times, _) in sorted(stored.items(), key=lambda x: x[1][1])}
        return {self.part: inner} | ({self.mark: mark} if self.mark and mark is not None else {}), stored, place

    def _inner(self, times: tuple):
        return list(times) if self.mark else times[0]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        held, stored, place = self._held()
        pdf = pd.concat(list(rows)).sort_values(["at_seconds", self.id_column])
        out, used = [], {}
        for at, value in zip(pdf["at_seconds"], pdf["event_value"], strict=True):
            value = None if value is None or value != value else str(value)
            out.append(self.machine(held, float(at), value))
            place += 1
            used[value or ""] = place
        now = {k or "": tuple(v) if self.mark else (v,) for k, v in held.get(self.part, {}).items()}
        for gone in stored.keys() - now.keys():
            self.entries.removeKey((gone,))
        for k, times in now.items():
            if k not in stored or stored[k][0] != times or k in used:
                self.entries.updateValue((k,), (list(times), used.get(k, stored.get(k, ((), 0))[1])))
        self.rest.update((held.get(self.mark) if self.mark else None, place))
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        last = max((t for times in now.values() for t in times), default=float(pdf["at_seconds"].max()))
        self.handle.registerTimer(max(int((last + self.idle) * 1000), timers.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({self.id_column: pdf[self.id_column].to_numpy(), self.group: key[0], self.names[0]: [x[0] for x in out], self.names[1]: [x[1] for x in out]})

    def handleExpiredTimer(self, key: tuple, timers, expired) -> Iterator[pd.DataFrame]:
        self.entries.clear()
        self.rest.clear()
        yield from ()

    def close(self) -> None:
        pass


def _run(events: DataFrame, group: str, at: str, value: str, id_column: str, processor: _Mapped, kinds: tuple[str, str], delay: str) -> DataFrame:
    stamped = events.select(id_column, group, F.col(at).cast("timestamp").alias("event_ts"), F.col(value).cast("string").alias("event_value")).withWatermark("event_ts", delay)
    rows = stamped.withColumn("at_seconds", seconds_of(F.col("event_ts")))
    of = lambda c: f"`{c}` {events.schema[c].dataType.simpleString()}"
    schema = f"{of(id_column)}, {of(group)}, {processor.names[0]} {kinds[0]}, {processor.names[1]} {kinds[1]}"
    return rows.groupBy(group).transformWithStateInPandas(processor, schema, "append", "eventTime")


def store(events: DataFrame, group: str, at: str, key: str, id_column: str, seconds: float, most: int, names: tuple[str, str] = ("hit", "held"), delay: str = "24 hours") -> DataFrame:
    """state.store as a stream: each group keeps its most recently used keys,
    most at a time, for seconds after their last use. An empty key and a null
    one are the same. Events later than delay are dropped."""
    return _run(events, group, at, key, id_column, _Mapped(state.store(seconds, most), group, id_column, names, "held", None, seconds), ("boolean", "long"), delay)


def callers(events: DataFrame, group: str, at: str, caller: str, id_column: str, limit: int, seconds: float, cap: int, names: tuple[str, str] = ("accepted", "tracked"), delay: str = "24 hours") -> DataFrame:
    """state.tracked_limiter as a stream: a table of callers for each group,
    which may be a service, or a share of all callers with its share of cap."""
    return _run(events, group, at, caller, id_column, _Mapped(state.tracked_limiter(limit, seconds, cap), group, id_column, names, "seen", "swept", seconds), ("boolean", "long"), delay)
