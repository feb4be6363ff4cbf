"""Rate limits, bans and sessions on streams, and late ratings joined with the requests they are about.

What becomes of a row depends on the rows before it, so a stream must take them in order of event time whatever order they arrive
in. Each key holds its rows until the watermark has passed them; a timer then folds them, in order, into the key's state. Rows
later than the watermark are dropped by Spark. Timers of the state's own end bans and sessions without another row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from .folds import BANS

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Outputs = list[tuple]


class Fold:
    """How a key's rows change its state (a dict that JSON can hold); times are microseconds."""

    #: Columns of a row that the fold reads beside its id, and those that it gives.
    reads: tuple[str, ...] = ()
    output = ""

    def step(self, state: dict, at: int, row: dict) -> Outputs:
        """What a row gives."""
        raise NotImplementedError

    def due(self, state: dict) -> int | None:
        """When the state changes without a row, if it does."""
        return None

    def ended(self, state: dict, at: int) -> Outputs:
        """What becomes of the state then."""
        return []


class RateLimit(Fold):
    """accepted: whether fewer than ``most`` rows of the key were accepted in the span before."""

    output = "accepted boolean"

    def __init__(self, most: int, seconds: float):
        self.most, self.span = most, int(seconds * 1_000_000)

    def step(self, state: dict, at: int, row: dict) -> Outputs:
        times = [t for t in state.get("times", []) if t > at - self.span]
        accepted = len(times) < self.most
        state["times"] = [*times, at] if accepted else times
        return [(row["event_id"], at, accepted)]


class Bans(Fold):
    """kind attempt: attempts so far, whether blocked, and until when; kind ended, without an event_id: a ban ran out at ts."""

    reads = ("failed",)
    output = "kind string, attempts bigint, blocked boolean, blocked_until timestamp"

    def step(self, state: dict, at: int, row: dict) -> Outputs:
        until = state.get("until")
        if until is not None and until > at:
            return [(row["event_id"], at, "attempt", state["n"], True, _time(until))]
        if not row["failed"]:
            state.clear()
            return [(row["event_id"], at, "attempt", 0, False, None)]
        state["n"] = state.get("n", 0) + 1
        minutes = next((m for least, m in BANS if state["n"] >= least), 0)
        if minutes:
            state["until"], state["open"] = at + minutes * 60_000_000, True
        return [(row["event_id"], at, "attempt", state["n"], False, _time(state.get("until")))]

    def due(self, state: dict) -> int | None:
        return state.get("until") if state.get("open") else None

    def ended(self, state: dict, at: int) -> Outputs:
        state["open"] = False
        return [(None, at, "ended", state["n"], False, _time(at))]


class Sessions(Fold):
    """A row for each session, once no row can belong to it any more: session (from 1), events, first_ts, last_ts."""

    output = "session bigint, events bigint, first_ts timestamp, last_ts timestamp"

    def __init__(self, pause: float):
        self.pause = int(pause * 1_000_000)

    def _closed(self, state: dict) -> Outputs:
        n, first, last = state.pop("events"), state.pop("first"), state.pop("last")
        return [(None, last, state["session"], n, _time(first), _time(last))]

    def step(self, state: dict, at: int, row: dict) -> Outputs:
        out = self._closed(state) if "last" in state and at - state["last"] > self.pause else []
        if "last" not in state:
            state |= {"session": state.get("session", 0) + 1, "events": 0, "first": at}
        state["events"], state["last"] = state["events"] + 1, at
        return out

    def due(self, state: dict) -> int | None:
        return state["last"] + self.pause + 1 if "last" in state else None

    def ended(self, state: dict, at: int) -> Outputs:
        return self._closed(state)


def _time(micros: int | None) -> datetime | None:
    return None if micros is None else datetime.fromtimestamp(micros // 1_000_000, UTC).replace(microsecond=micros % 1_000_000, tzinfo=None)


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them and gives them to a fold in order of time and id."""

    def __init__(self, fold: Fold, names: list[str], read: list[str]):
        self.fold, self.names, self.read = fold, names, read

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros bigint, event_id bigint, row string")
        self.state = handle.getValueState("state", "json string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = set()
        for pdf in rows:
            for row in pdf.to_dict("records"):
                self.waiting.appendValue((row["micros"], row["event_id"], json.dumps({c: row[c] for c in self.read})))
                due.add(_millis(row["micros"]))
        for at in due:
            self.handle.registerTimer(at)
        yield self._frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """All rows up to this timer, and what the state itself has due between them, in order."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        held = sorted(self.waiting.get())
        ready = [x for x in held if _millis(x[0]) <= now]
        later = [x for x in held if _millis(x[0]) > now]
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.put([tuple(x) for x in later])
        state = json.loads(self.state.get()[0]) if self.state.exists() else {}
        before, out = self.fold.due(state), []
        for micros, _, row in ready:
            while (at := self.fold.due(state)) is not None and at <= micros:
                out += self.fold.ended(state, at)
            out += self.fold.step(state, micros, json.loads(row))
        while (at := self.fold.due(state)) is not None and _millis(at) <= now:
            out += self.fold.ended(state, at)
        after = self.fold.due(state)
        if after is not None and after != before:
            self.handle.registerTimer(_millis(after))
        if state:
            self.state.update((json.dumps(state),))
        else:
            self.state.clear()
        yield self._frame(key, out)

    def _frame(self, key, out: Outputs) -> pd.DataFrame:
        columns = list(zip(*out, strict=True)) if out else [[] for _ in self.names[1:]]
        own = [pd.Series([key[0]] * len(out), dtype=object), pd.Series(columns[0], dtype="Int64"), pd.Series([_time(t) for t in columns[1]], dtype="datetime64[us]")]
        rest = [pd.Series(list(c), dtype=object) for c in columns[2:]]
        return pd.DataFrame(dict(zip(self.names, [*own, *rest], strict=True)))

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    """The first whole millisecond from then on: timers know no finer times."""
    return -(-micros // 1000)


def with_rocks(spark: SparkSession) -> None:
    """Keyed state needs this store; a session that names another keeps it."""
    if "HDFSBacked" in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "HDFSBacked"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def folded(stream: DataFrame, key: str, fold: Fold, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """key, event_id, ts and the fold's columns, in append mode. stream has the key, event_id (a whole number), ts, and what the fold reads.

    A null key is a key of its own; rows later than ``late`` behind the newest are dropped. Rows of one key and time go by their event_id.
    """
    with_rocks(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, event_id bigint, ts timestamp, {fold.output}"
    read = ["event_id", *fold.reads]
    rows = stream.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late).select(key, "_at", F.unix_micros("_at").alias("micros"), *read)
    names = StructType.fromDDL(schema).names
    return rows.groupBy(key).transformWithStateInPandas(InOrder(fold, names, read), schema, "Append", "EventTime")


def rate_limited_stream(requests: DataFrame, key: str, most: int = 3, seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """As folds.rate_limited: key, event_id, ts, accepted."""
    return folded(requests, key, RateLimit(most, seconds), late)


def progressive_bans_stream(attempts: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """As folds.progressive_bans, with a row for each ban that ran out."""
    return folded(attempts, key, Bans(), late)


def sessions_stream(events: DataFrame, key: str, pause: float = 1800.0, late: str = "10 minutes") -> DataFrame:
    """Sessions that a pause of more than so many seconds ends; the state of a key keeps their number alone between them."""
    return folded(events, key, Sessions(pause), late).drop("event_id", "ts")


def late_feedback(requests: DataFrame, ratings: DataFrame, key: str, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """f_id, request, positive: each rating (key, f_id, f_ts, positive) with its key's newest request (key, event_id, ts) of the time before.

    For tables and streams alike. On streams, a request leaves the state when no rating can reach it, and a rating's row is given
    once no request before it can come any more. Of requests of one time the larger event_id counts.
    """
    asked, rated = requests.select(F.col(key).alias("_key"), "event_id", "ts"), ratings.select(key, "f_id", "f_ts", "positive")
    if requests.isStreaming:
        asked, rated = asked.withWatermark("ts", late), rated.withWatermark("f_ts", late)
    span = F.expr(f"INTERVAL {within}")
    met = rated.join(asked, F.expr(f"{key} <=> _key") & (F.col("ts") <= F.col("f_ts")) & (F.col("ts") >= F.col("f_ts") - span))
    newest = F.max(F.struct("ts", "event_id"))["event_id"].alias("request")
    return met.groupBy("f_id", "f_ts", "positive").agg(newest).select("f_id", "request", "positive")
