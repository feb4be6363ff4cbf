"""Keyed state over ordered rows: rate limits and bans.

Whether a request counts depends on what became of those before it, which no window frame expresses. Rows are dealt by key
and sorted; a task then reads them batch by batch and holds the state of the key at hand alone. The rows of one key are
necessarily taken one after another, but never gathered.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Failed attempts from which a ban lasts so many minutes.
BANS = ((15, 1440), (10, 60), (5, 15))


def fold_in_order(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, added: str) -> DataFrame:
    """df with the columns named in ``added`` (DDL). step(state, row) gives their values for a row and changes the state.

    A null key is a key of its own; equal places in the order stay together but in no stated order, so order should end in an id.
    """
    names = [c.split()[0] for c in added.split(",")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = object()
        held, state = none, None
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                now = getattr(row, key)
                now = None if pd.isna(now) else now
                if held is none or now != held:
                    held, state = now, start()
                rows.append(step(state, row))
            yield pdf.assign(**{n: [r[i] for r in rows] for i, n in enumerate(names)})

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, f"{fields}, {added}")


def rate_limited(requests: DataFrame, key: str, ts: str = "ts", order: list[str] = ("event_id",), most: int = 3, seconds: float = 60.0) -> DataFrame:
    """Adds accepted: whether fewer than ``most`` requests of the key were accepted in the seconds before. Rejected ones are not recorded."""
    span = pd.Timedelta(seconds=seconds)

    def step(times: deque, row) -> tuple:
        now = getattr(row, ts)
        while times and times[0] <= now - span:
            times.popleft()
        if len(times) >= most:
            return (False,)
        times.append(now)
        return (True,)

    return fold_in_order(requests, key, [ts, *order], deque, step, "accepted boolean")


def progressive_bans(attempts: DataFrame, key: str, ts: str = "ts", order: list[str] = ("event_id",)) -> DataFrame:
    """attempts with ``failed`` -> adds attempts (recorded so far), blocked, and blocked_until.

    While a key is blocked its attempts are not recorded; a success clears all.
    """

    def step(state: dict, row) -> tuple:
        now, until = getattr(row, ts), state.get("until")
        if until is not None and until > now:
            return state["n"], True, until
        if not row.failed:
            state.clear()
            return 0, False, None
        state["n"] = state.get("n", 0) + 1
        minutes = next((m for least, m in BANS if state["n"] >= least), 0)
        if minutes:
            state["until"] = now + pd.Timedelta(minutes=minutes)
        return state["n"], False, state.get("until")

    return fold_in_order(attempts, key, [ts, *order], dict, step, "attempts long, blocked boolean, blocked_until timestamp")
