"""States merged batch by batch against one pass over all ratings; a batch that comes again changes nothing."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import learning
from strandline.streaming import learned_state

SCHEMA = "ts long, keywords array<string>, source string, positive boolean"


def ratings(spark, n=240, seed=2):
    r = random.Random(seed)
    rows = [(i, r.sample("abcde", 2), r.choice(["s1", "s1", "s2", None]), r.random() < 0.6) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_counts_of_batches_are_those_of_all(spark):
    df, rows = ratings(spark)
    state = learned_state.source_counts(spark)
    for b in range(3):
        state.fold(df.filter(F.col("ts") % 3 == b), b + 1)
    state.fold(df.filter(F.col("ts") % 3 == 2), 3)  # the last batch again
    got = {x.source: (x.positive, x.n) for x in state.read().collect()}
    assert got == {s: (sum(r[3] for r in rows if r[2] == s), sum(r[2] == s for r in rows)) for s in ("s1", "s2", None)}
    state.fold(df.limit(0), 4)
    assert state.read().count() == 3


def test_weights_of_ascending_batches_are_those_of_all(spark):
    df, rows = ratings(spark)
    state = learned_state.term_runs(spark, ["ts"], F.floor(F.col("ts") / 10))
    for b, (low, high) in enumerate([(0, 50), (50, 51), (51, 240)], 1):
        state.fold(df.filter(F.col("ts").between(low, high - 1)), b)
    want = dict.fromkeys("abcde", learning.START)
    for _, keywords, _, positive in rows:
        for k in keywords:
            want[k] = max(learning.LEAST, min(learning.MOST, want[k] + (learning.UP if positive else learning.DOWN)))
    got = {x.term: min(x.high, max(x.low, learning.START + x.add)) for x in state.read().collect()}
    assert got == pytest.approx(want)


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    df, _ = ratings(spark)
    state = learned_state.mapping_counts(spark)
    for half in (0, 1):
        df.filter(F.col("ts") % 2 == half).write.mode("append").parquet(f"{tmp_path}/in")
        state.fold_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/checkpoint")
    state.fold_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/checkpoint")
    once = learned_state.mapping_counts(spark)
    once.fold(df, 1)
    plain = lambda s: sorted(map(str, s.read().collect()))
    assert plain(state) == plain(once)
