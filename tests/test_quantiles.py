"""Order statistics and quantiles against sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import quantiles as q


def ranks(n):
    return [n * 0, F.floor(n * 0.5), F.floor(n * 0.95), n - 1, n + 5]


@pytest.mark.parametrize("broadcast", [q.BROADCAST, 0])
def test_equals_sorted_lists(spark, monkeypatch, broadcast):
    monkeypatch.setattr(q, "BROADCAST", broadcast)
    r = random.Random(3)
    groups = {
        "hot": [r.lognormvariate(0, 4) for _ in range(5000)],
        "ties": [float(r.randrange(3)) for _ in range(3000)],
        "same": [7.0] * 500,
        "one": [-1.5],
        None: [r.gauss(0, 1) for _ in range(700)],
        "odd": [math.inf, -math.inf, math.nan, 0.0, -2.0],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("hot", None), ("nulls", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    got = {x.g: (x.n, x.picked) for x in q.order_statistics(df, "g", "value", ranks).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        n, s = len(vs), sorted(vs, key=lambda v: (math.isnan(v), 0 if math.isnan(v) else v))
        want = [s[0], s[n // 2], s[min(n - 1, math.floor(n * 0.95))], s[-1], s[-1]]
        assert got[g][0] == n and [str(v) for v in got[g][1]] == [str(v) for v in want]


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    """With a grid that is wrong by design every bracket misses its ranks, and the values are right all the same."""
    monkeypatch.setattr(q.F, "percentile_approx", lambda c, shares, accuracy: F.array(*[F.min(c) for _ in shares]))
    df = spark.range(2000).select(F.lit("a").alias("g"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("value"))
    want = sorted(x.value for x in df.collect())
    got = q.order_statistics(df, "g", "value", lambda n: [F.floor(n * 0.3), F.floor(n * 0.9)]).first()
    assert got.picked == [float(want[600]), float(want[1800])]


def test_quantiles_between_neighbours(spark):
    r = np.random.default_rng(5)
    values = r.exponential(size=4001)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 1.0), ("b", 2.0)], "g string, value double")
    got = {x.g: x["quantiles"] for x in q.quantiles(df, "g", "value", [0.0, 0.333, 0.95, 1.0]).collect()}
    assert np.allclose(got["a"], np.quantile(values, [0.0, 0.333, 0.95, 1.0]), rtol=1e-12, atol=0)
    assert np.allclose(got["b"], [1.0, 1.333, 1.95, 2.0])
    assert q.quantiles(df.limit(0), "g", "value", [0.5]).count() == 0
