"""Keyed state, term weights, subsequences and greedy picks against plain loops."""

import datetime as dt
import random
from collections import defaultdict

from pyspark.sql import functions as F

from strandline.functions import grading
from strandline.operators import learning, retrieval
from strandline.streaming import folds

START = dt.datetime(2024, 1, 1)


def events(seed=5, n=600):
    r = random.Random(seed)
    times = sorted(START + dt.timedelta(seconds=r.randrange(20_000)) for _ in range(n))
    return [(i, None if r.random() < 0.05 else r.choice([1, 1, 1, 2, 3]), t, r.random() < 0.8, r.randrange(6)) for i, t in enumerate(times)]


def table(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user long, ts timestamp, failed boolean, entry int")


def by_user(rows):
    groups = defaultdict(list)
    for x in rows:
        groups[x[1]].append(x)
    return groups


def test_rate_limit(spark):
    rows, want = events(), {}
    for group in by_user(rows).values():
        for i, _, t, _, _ in group:
            accepted = [x for x in group if want.get(x[0]) and t - x[2] < dt.timedelta(seconds=60)]
            want[i] = len(accepted) < 2
    got = folds.rate_limited(table(spark, rows), "user", most=2, seconds=60.0)
    assert {x.event_id: x.accepted for x in got.collect()} == want
    assert folds.rate_limited(table(spark, rows).limit(0), "user").count() == 0


def test_bans(spark):
    rows, want = events(6), {}
    for group in by_user(rows).values():
        n, until = 0, None
        for i, _, t, failed, _ in group:
            if until and until > t:
                want[i] = (n, True)
                continue
            if not failed:
                n, until = 0, None
            else:
                n += 1
                minutes = 1440 if n >= 15 else 60 if n >= 10 else 15 if n >= 5 else 0
                until = t + dt.timedelta(minutes=minutes) if minutes else until
            want[i] = (n, False)
    got = folds.progressive_bans(table(spark, rows), "user")
    assert {x.event_id: (x.attempts, x.blocked) for x in got.collect()} == want
    assert any(b for _, b in want.values())



def test_term_weights_with_bounds(spark):
    r = random.Random(3)
    rows = [(i, r.choice("ab"), r.random() < (0.9 if i < 150 else 0.1)) for i in range(400)]
    want = {"a": 1.0, "b": 1.0}
    for _, term, positive in rows:
        want[term] = min(3.0, max(0.5, want[term] + (0.1 if positive else -0.05)))
    df = spark.createDataFrame(rows, "i long, term string, positive boolean")
    got = dict(learning.term_weights(df, "term", ["i"], F.floor(F.col("i") / 37)).collect())
    assert {k: round(v, 6) for k, v in want.items()} == got


def test_common_length():
    r = random.Random(1)
    for _ in range(60):
        a, b = (["abcd"[r.randrange(4)] for _ in range(r.randrange(90))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(new[-1], row[j]))
            row = new
        assert grading.common_length(a, b) == row[-1]


def test_greedy_distinct(spark):
    words = [["a", "b", "c"], ["a", "b", "c"], ["a", "b", "d"], ["x"], [], []]
    df = spark.createDataFrame([("q", i + 1, i, w) for i, w in enumerate(words)], "q string, rank int, doc long, words array<string>")
    assert [x.doc for x in retrieval.greedy_distinct(df, "q", "doc", 0.85).orderBy("doc").collect()] == [0, 2, 3, 4]
