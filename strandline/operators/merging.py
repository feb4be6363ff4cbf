"""Upserts and data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import is_empty, rate


def smart_upsert(old: DataFrame, new: DataFrame, key: str, forced: list[str] = ()) -> DataFrame:
    """Merge by key: forced columns take the new value always, others only if it is not empty; action tells what happened."""
    columns = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    there, given = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()

    def merged(c: str):
        taken = given if c in forced else given & ~is_empty(F.col(f"n.{c}"))
        return F.when(taken, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)

    action = F.when(there & given, "updated").when(given, "inserted").otherwise("kept")
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *map(merged, columns), action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old with the fields that new has for their key, and the rows that only new has; a null in new changes nothing."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    fields = [F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c) for c in old.columns if c != key]
    return both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *fields)


def disjoint_spans(spans: DataFrame, key: str) -> DataFrame:
    """spans (key, a, b, kind, both ends inclusive) without those that overlap a larger one that stays; of equal ones the earlier.

    The spans of a key are one array, sorted by size and folded: a span stays if it meets none that stayed before it.
    """
    size = (F.col("a") - F.col("b")).alias("size")  # negative, so that the largest comes first
    lists = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(size, "a", "b", "kind"))).alias("l"))
    none = F.filter("l", lambda x: F.lit(False))
    kept = F.aggregate("l", none, lambda done, x: F.when(F.exists(done, lambda y: (x["a"] <= y["b"]) & (y["a"] <= x["b"])), done).otherwise(F.concat(done, F.array(x))))
    return lists.select(key, F.explode(kept).alias("x")).select(key, "x.a", "x.b", "x.kind")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, missing, empty, filled, fill_rate: one pass over the table, one row per column."""
    counts = []
    for c in columns:
        null, blank = F.col(c).isNull(), is_empty(F.col(c))
        counts += [F.count_if(null).alias(f"m_{c}"), F.count_if(blank & ~null).alias(f"e_{c}"), F.count_if(~blank).alias(f"f_{c}")]
    totals = df.agg(F.count("*").alias("n"), *counts)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m_{c}").alias("missing"), F.col(f"e_{c}").alias("empty"), F.col(f"f_{c}").alias("filled"), rate(F.col(f"f_{c}"), F.col("n")).alias("fill_rate")) for c in columns])
    return totals.select(F.inline(rows))
