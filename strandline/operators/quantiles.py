"""Exact order statistics of groups of any size: no group is gathered in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Steps of the grid that a sketch gives of each group, the sketch's accuracy (errors are a fiftieth of a step), and steps of slack.
GRID, ACCURACY, SLACK = 200, 10_000, 1
#: As many brackets are broadcast at most; more are joined by shuffles, in this many salted shares of each group.
BROADCAST, SALTS = 20_000, 16


def _met(rows: DataFrame, brackets: DataFrame, by: str, few: bool, cond: Column) -> DataFrame:
    """rows (by, v) with the brackets (by, lo, hi) of their group for which cond is true."""
    if few:
        return rows.alias("r").join(F.broadcast(brackets.alias("b")), (F.col(f"r.{by}").eqNullSafe(F.col(f"b.{by}"))) & cond).select(f"r.{by}", "v", "lo", "hi")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    dealt = brackets.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    r, b = salted.alias("r"), dealt.alias("b")
    return r.join(b, F.col(f"r.{by}").eqNullSafe(F.col(f"b.{by}")) & (F.col("r.salt") == F.col("b.salt")) & cond).select(f"r.{by}", "v", "lo", "hi")


def order_statistics(df: DataFrame, by: str, value: str, ranks: Callable[[Column], list[Column]]) -> DataFrame:
    """(by, n, picked): n values of a group, and of its ascending values those at ranks(n), from 0, in the order asked for.

    Null values do not count; a group of nulls has no row, a null ``by`` is a group. NaN is above all numbers. A rank outside 0..n-1 is
    the nearest within.

    A sketch (merged from all tasks) gives a bracket of values about each rank: less than two hundredths of the group. How many values lie
    below and within is counted exactly, and a bracket that misses its rank is widened to the group's end. What lies within is aggregated
    by value and range-partitioned; each partition's counts give where its ranks begin, and only within a partition are values ranked one by one.
    """
    rows = df.select(F.col(by), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    grid = F.percentile_approx("v", [i / GRID for i in range(GRID + 1)], ACCURACY)
    sizes = rows.groupBy(by).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"), grid.alias("grid"))
    n = F.col("n")
    asked = F.transform(F.array(*[t.cast("long") for t in ranks(n)]), lambda t: F.least(n - 1, F.greatest(F.lit(0).cast("long"), t)))
    wanted = sizes.select(by, "n", "least", "most", "grid", F.posexplode(asked).alias("i", "t"))
    step = F.floor(F.col("t") * GRID / n).cast("int")
    low = F.when(step <= SLACK, F.col("least")).otherwise(F.element_at("grid", F.greatest(F.lit(1), step - SLACK + 1)))
    high = F.when(step + SLACK + 1 >= GRID, F.col("most")).otherwise(F.element_at("grid", F.least(F.lit(GRID + 1), step + SLACK + 2)))
    wanted = stored(wanted.select(by, "n", "i", "t", "least", "most", low.alias("lo"), high.alias("hi")), "ranks")

    few = wanted.limit(BROADCAST + 1).count() <= BROADCAST
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    counts = _met(rows, wanted.select(by, "lo", "hi").distinct(), by, few, F.col("v") <= F.col("hi")).groupBy(by, "lo", "hi").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(inside).alias("within"))
    w, c = wanted.alias("w"), counts.alias("c")
    same = F.col(f"w.{by}").eqNullSafe(F.col(f"c.{by}")) & (F.col("w.lo") == F.col("c.lo")) & (F.col("w.hi") == F.col("c.hi"))
    short, past = F.col("t") < F.col("below"), F.col("t") >= F.col("below") + F.col("within")
    below = F.when(short, F.lit(0).cast("long")).otherwise(F.col("below"))
    settled = w.join(c, same).select(f"w.{by}", "n", "i", (F.col("t") - below).alias("t"), F.when(short, F.col("least")).otherwise(F.col("w.lo")).alias("lo"), F.when(past, F.col("most")).otherwise(F.col("w.hi")).alias("hi"))
    settled = stored(settled, "brackets")

    held = _met(rows, settled.select(by, "lo", "hi").distinct(), by, few, inside).groupBy(by, "lo", "hi", "v").agg(F.count("*").alias("c"))
    # kept as a table, so that a partition's number and rows stay together whatever is computed again
    held = stored(held.repartitionByRange(by, "lo", "hi", "v").withColumn("p", F.spark_partition_id()), "ranges")
    group = [by, "lo", "hi"]
    before = Window.partitionBy(*group).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy(*group, "p").agg(F.sum("c").alias("m")).withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0).cast("long")))
    s, x = starts.alias("s"), settled.alias("x")
    of = lambda a, b: F.col(f"{a}.{by}").eqNullSafe(F.col(f"{b}.{by}")) & (F.col(f"{a}.lo") == F.col(f"{b}.lo")) & (F.col(f"{a}.hi") == F.col(f"{b}.hi"))
    holding = x.join(s, of("x", "s") & (F.col("t") >= F.col("start")) & (F.col("t") < F.col("start") + F.col("m"))).select(f"x.{by}", "n", "i", "x.lo", "x.hi", "p", (F.col("t") - F.col("start")).alias("t"))
    upto = F.sum("c").over(Window.partitionBy(*group, "p").orderBy("v"))
    h, y = held.withColumn("upto", upto).alias("h"), holding.alias("y")
    there = of("h", "y") & (F.col("h.p") == F.col("y.p")) & (F.col("t") < F.col("upto")) & (F.col("t") >= F.col("upto") - F.col("c"))
    found = y.join(h, there).select(f"y.{by}", "n", "i", "v")
    return found.groupBy(by, "n").agg(F.sort_array(F.collect_list(F.struct("i", "v")))["v"].alias("picked"))


def quantiles(df: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """(by, n, quantiles): for each share the value at (n - 1) * share, between neighbours in proportion."""
    at = lambda n: [f((n - 1) * p) for p in shares for f in (F.floor, F.ceil)]
    found = order_statistics(df, by, value, at)

    def between(i: int, p: float) -> Column:
        a, b = F.col("picked")[2 * i], F.col("picked")[2 * i + 1]
        place = (F.col("n") - 1) * F.lit(p)
        return F.when(a == b, a).otherwise(a + (b - a) * (place - F.floor(place)))

    return found.select(by, "n", F.array(*[between(i, p) for i, p in enumerate(shares)]).alias("quantiles"))
