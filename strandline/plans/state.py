"""Rate limits and bans over events in order. No SQL expresses them; tests hold them against plain loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import folds
from .registry import query
from .views import AS_OF, metrics


@query()
def z04_rate_limit(spark, sf_dir):
    """At most three requests of a user within two hours."""
    m = metrics(spark, sf_dir).select("event_id", "user_id", "ts")
    return folds.rate_limited(m, "user_id", most=3, seconds=7200.0)


def _bans(spark, sf_dir):
    m = metrics(spark, sf_dir).select("event_id", "user_id", "ts", (F.col("event_type") != "purchase").alias("failed"))
    return folds.progressive_bans(m, "user_id")


@query()
def z05_progressive_bans(spark, sf_dir):
    return _bans(spark, sf_dir)


@query()
def k06_blocked_list(spark, sf_dir):
    """Users blocked at a given moment, those blocked longest first, with the minutes left; ten are shown."""
    at = F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 10 DAY")
    last = _bans(spark, sf_dir).filter(F.col("ts") <= at).groupBy("user_id").agg(F.max_by("blocked_until", F.struct("ts", "event_id")).alias("until"))
    left = (F.floor((F.unix_timestamp("until") - F.unix_timestamp(at)) / 60) + 1).alias("minutes_left")
    return last.filter(F.col("until") > at).select("user_id", "until", left).orderBy(F.desc("until"), "user_id").limit(10)
