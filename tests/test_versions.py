"""Versioned tables: old versions stay readable, untouched files unchanged, overtaken writers are told."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.operators import merging
from strandline.sources.tables import shared_path
from strandline.sources.versions import Versions

SCHEMA = "k long, source string, text string"


def made(spark, rows, by="source", **other):
    df = spark.createDataFrame(rows, SCHEMA)
    t = Versions(spark, shared_path(spark, "versions"), df.schema, "k", by, **other)
    return t, df


def held(t, version=None):
    return sorted(map(tuple, t.read(version).collect()), key=str)


def test_replace_one_source_leaves_the_files_of_others(spark):
    rows = [(i, f"s{i % 5}", f"text {i}") for i in range(200)]
    t, df = made(spark, rows, parts=64, spread=2)
    assert t.latest() == 0 and held(t) == []
    assert t.insert(df) == 1
    before = t.folders(1)
    assert t.replace(["s3"], spark.createDataFrame([(3, "s3", "new"), (1000, "s3", "more")], SCHEMA)) == 2
    assert held(t, 1) == sorted(rows, key=str)
    assert held(t, 2) == sorted([r for r in rows if r[1] != "s3"] + [(3, "s3", "new"), (1000, "s3", "more")], key=str)
    after = t.folders(2)
    same = {p for p in before if after.get(p) == before[p]}
    assert len(before) - len(same) <= 2  # the parts of one source
    assert {r[1] for r in t.read(2, same).distinct().collect()} >= {"s0", "s1", "s2", "s4"} - {r[1] for r in t.read(1, set(before) - same).collect()}


def test_upsert_rewrites_touched_parts_only(spark):
    rows = [(i, None if i % 9 == 0 else "s", f"text {i}") for i in range(100)]
    t, df = made(spark, rows, by=None, parts=16)
    t.insert(df)
    new = spark.createDataFrame([(5, "s", "changed"), (500, "s", "added")], SCHEMA)
    t.change(new, lambda o, n: merging.upsert(o, n, "k").select("k", "source", "text"))
    want = [r for r in rows if r[0] != 5] + [(5, "s", "changed"), (500, "s", "added")]
    assert held(t) == sorted(want, key=str) and held(t, 1) == sorted(rows, key=str)
    assert sum(t.folders(1).get(p) != f for p, f in t.folders(2).items()) <= 2


def test_purge_dry_run_then_execution_and_forgetting(spark):
    t, df = made(spark, [(i, "a", None if i == 7 else "x" * i) for i in range(60)] + [(None, None, "")])
    t.insert(df)
    short = F.length("text") < 10
    assert t.purge(short, dry_run=True) == (1, 10) and t.latest() == 1
    assert t.purge(short) == (2, 10)
    assert t.read().count() == 51 and t.read(1).count() == 61  # a null text is not known to be short
    assert t.purge(short) == (2, 0)
    kept = held(t)
    assert t.forget(keep=1) and held(t) == kept and t.latest() == 2


def test_overtaken_writer_changes_nothing(spark):
    t, df = made(spark, [(1, "a", "x"), (2, "b", "y")])
    t.insert(df)
    t.insert(spark.createDataFrame([(3, "a", "z")], SCHEMA))
    with pytest.raises(FileExistsError):
        t._switch(2, {})
    assert t.read().count() == 3
    with pytest.raises(ValueError):
        t.change(spark.createDataFrame([(1, "a", "p"), (1, "a", "q")], SCHEMA), lambda o, n: n)
    assert t.insert(spark.createDataFrame([], SCHEMA)) == 2


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 1000))
def test_any_order_of_changes_equals_a_dict(spark, seed):
    r = random.Random(seed)
    t, _ = made(spark, [], parts=8, spread=3)
    state = {}
    for step in range(3):
        new = {(r.choice(["a", "b", None]), r.randrange(12)): f"{step}-{r.random():.4f}" for _ in range(5)}
        df = spark.createDataFrame([(k, s, x) for (s, k), x in new.items()], SCHEMA)
        if r.random() < 0.5:
            sources = list({s for s, _ in new})
            t.replace(sources, df)
            state = {k: v for k, v in state.items() if k[0] not in sources} | new
        else:
            same = ["k", "source"]
            t.change(df, lambda o, n: o.alias("o").join(n.alias("n"), (F.col("o.k") == F.col("n.k")) & F.col("o.source").eqNullSafe(F.col("n.source")), "full").select(*[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in [*same, "text"]]))
            state |= new
        assert held(t) == sorted([(k, s, x) for (s, k), x in state.items()], key=str)
