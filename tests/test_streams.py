"""Keyed state and joins on streams against the same over tables and plain loops; late rows and expiry included."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandline.streaming import folds, keyed_state
from strandline.streaming.windows import first_of_each

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, user string, ts timestamp, failed boolean"
#: A row far ahead, so that the watermark passes all others.
FLUSH = (10_000, "flush", START + dt.timedelta(days=9), True)


def rows(seed=4, n=400, users="aab c"):
    r = random.Random(seed)
    times = sorted(START + dt.timedelta(seconds=r.randrange(30_000), microseconds=r.choice([0, 1, 999_999])) for _ in range(n))
    return [(i, r.choice([*users, None]), t, r.random() < 0.85) for i, t in enumerate(times)]


def streamed(spark, folder, batches, schema, make, name):
    """All that make(stream) gives when the batches arrive one by one."""
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in/{i:03}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/in")
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def shuffled(every, seed=1, parts=4):
    """The rows in batches of rising time, each in another order, with neighbours exchanged across batches."""
    r = random.Random(seed)
    moved = sorted(every, key=lambda x: x[2] + dt.timedelta(seconds=r.randrange(-250, 250)))
    size = -(-len(moved) // parts)
    batches = [moved[i : i + size] for i in range(0, len(moved), size)]
    for b in batches:
        r.shuffle(b)
    return [*batches, [FLUSH]]


def key(x):
    return tuple(str(v) for v in x)


@pytest.fixture(autouse=True)
def two_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rate_limits_equal_those_of_a_table(spark, tmp_path):
    every = rows()
    got = streamed(spark, tmp_path, shuffled(every), SCHEMA, lambda s: keyed_state.rate_limited_stream(s, "user", 2, 600.0), "limits").filter("event_id < 10000")
    want = folds.rate_limited(spark.createDataFrame(every, SCHEMA), "user", most=2, seconds=600.0)
    assert sorted(map(key, got.select("event_id", "user", "ts", "accepted").collect())) == sorted(map(key, want.select("event_id", "user", "ts", "accepted").collect()))


def test_bans_equal_those_of_a_table_and_run_out(spark, tmp_path):
    every = rows(6)
    got = streamed(spark, tmp_path, shuffled(every), SCHEMA, lambda s: keyed_state.progressive_bans_stream(s, "user"), "bans").filter("coalesce(event_id, 0) < 10000 AND coalesce(user, '') <> 'flush'").collect()
    want = folds.progressive_bans(spark.createDataFrame(every, SCHEMA), "user").collect()
    fields = lambda x: key((x.event_id, x.user, x.ts, x.attempts, x.blocked, x.blocked_until))
    assert sorted(fields(x) for x in got if x.kind == "attempt") == sorted(map(fields, want))
    begun = {key((x.user, x.blocked_until)) for x in want if x.blocked_until and not x.blocked and x.attempts >= 5}
    ended = [key((x.user, x.blocked_until)) for x in got if x.kind == "ended"]
    assert ended and len(ended) == len(set(ended)) and set(ended) <= begun


def test_sessions_equal_plain_ones_and_late_rows_are_dropped(spark, tmp_path):
    every = [x for x in rows(8, 150)]
    late = (9000, "a", START - dt.timedelta(hours=5), True)
    batches = shuffled(every)
    batches[-1].append(late)  # arrives with the flush: older than the watermark by then
    got = streamed(spark, tmp_path, [*batches, [FLUSH[:2] + (FLUSH[2] + dt.timedelta(days=1), True)]], SCHEMA, lambda s: keyed_state.sessions_stream(s, "user", 300.0), "sessions").filter("coalesce(user, '') <> 'flush'")
    want = []
    for user in {x[1] for x in every}:
        times, n = sorted(x[2] for x in every if x[1] == user), 0
        groups = []
        for t in times:
            if groups and (t - groups[-1][-1]).total_seconds() <= 300:
                groups[-1].append(t)
            else:
                groups.append([t])
        for n, g in enumerate(groups, 1):
            want.append(key((user, n, len(g), g[0], g[-1])))
    assert sorted(map(key, got.select("user", "session", "events", "first_ts", "last_ts").collect())) == sorted(want)


def test_late_feedback_joins_within_its_bound(spark, tmp_path):
    every = rows(9, 300)
    asked = "event_id % 3 > 0"
    make = lambda s: keyed_state.late_feedback(
        s.filter(asked).select("user", "event_id", "ts"), s.filter(f"NOT ({asked})").select("user", F.col("event_id").alias("f_id"), F.col("ts").alias("f_ts"), F.col("failed").alias("positive")), "user", "10 minutes"
    )
    flush = [(10_000 + i, "flush", FLUSH[2] + dt.timedelta(seconds=i), True) for i in range(6)]
    got = streamed(spark, tmp_path, [*shuffled(every)[:-1], flush], SCHEMA, make, "feedback").filter("f_id < 10000")
    want = []
    for i, u, t, f in every:
        if i % 3 == 0:
            before = [(x[2], x[0]) for x in every if x[0] % 3 and x[1] == u and dt.timedelta(0) <= t - x[2] <= dt.timedelta(minutes=10)]
            want += [key((i, max(before)[1], f))] if before else []
    assert sorted(map(key, got.collect())) == sorted(want)
    assert sorted(map(key, make(spark.createDataFrame(every, SCHEMA)).collect())) == sorted(want)


def test_first_of_each_on_a_stream(spark, tmp_path):
    every = rows(3, 80)
    got = streamed(spark, tmp_path, shuffled(every), SCHEMA, lambda s: first_of_each(s, "user", late="10 days").select("user"), "firsts")
    assert sorted(map(key, got.collect())) == sorted({key((x[1],)) for x in every} | {("flush",)})
