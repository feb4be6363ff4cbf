"""Learning from ratings: keyword mappings, recommendations, term weights. What is learned from a part of the log merges with
what another part gave (``streaming.learned_state``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import top

#: A term's weight at first, its bounds, and what a rating adds.
START, LEAST, MOST, UP, DOWN = 1.0, 0.5, 3.0, 0.1, -0.05


def mapping_key(keywords: Column) -> Column:
    """Twelve digits that name a set of (at most five) keywords."""
    return F.substring(F.md5(F.array_join(F.array_sort(F.slice(keywords, 1, 5)), "_").cast("binary")), 1, 12)


def keyword_mappings(ratings: DataFrame) -> DataFrame:
    """ratings (keywords, source, positive) -> one row per keyword set: successes, failures, rate, preferred and avoided sources.

    Ratings are counted per set, source and sign before sources are gathered, so a set's row holds each source once.
    """
    counted = ratings.select(F.array_sort("keywords").alias("keywords"), "source", "positive").groupBy("keywords", "source", "positive").agg(F.count("*").alias("n"))
    good = F.col("positive")
    found = counted.groupBy("keywords").agg(
        F.coalesce(F.sum(F.when(good, F.col("n"))), F.lit(0)).alias("successes"),
        F.coalesce(F.sum(F.when(~good, F.col("n"))), F.lit(0)).alias("failures"),
        F.array_sort(F.collect_set(F.when(good, F.col("source")))).alias("preferred"),
        F.array_sort(F.collect_set(F.when(~good, F.col("source")))).alias("avoided"),
    )
    return found.withColumn("mapping", mapping_key(F.col("keywords"))).withColumn("rate", F.round(F.col("successes") / (F.col("successes") + F.col("failures")), 6))


def recommendations(asked: DataFrame, mappings: DataFrame, key: str, least_rate: float = 0.6, best: int = 3, limit: int = 5) -> DataFrame:
    """asked (key, keywords) -> key, recommended, avoided, confidence, from the best mappings that share a keyword.

    Keywords are joined as equal values, never as sets against sets.
    """
    good = mappings.filter(F.col("rate") >= least_rate).select("mapping", "rate", "preferred", F.col("avoided").alias("shunned"), F.explode("keywords").alias("word"))
    words = asked.select(key, F.explode(F.slice("keywords", 1, 5)).alias("word")).distinct()
    hits = words.join(good, "word").drop("word").dropDuplicates([key, "mapping"])
    chosen = top(hits, [key], [F.desc("rate"), F.col("mapping")], best)
    every = chosen.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("preferred")))).alias("p"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("shunned")))).alias("a"))
    found = every.select(key, F.slice("p", 1, limit).alias("recommended"), F.slice("a", 1, limit).alias("avoided"))
    return found.withColumn("confidence", F.least(F.lit(1.0), F.size("recommended") / F.lit(float(limit))))


def composed(a: dict[str, Column] | Column, b: dict[str, Column] | Column) -> dict[str, Column]:
    """The run "add, then bound from below and above" that does what run a and then run b do."""
    bounded = lambda x: F.least(b["high"], F.greatest(b["low"], x))
    return {"add": a["add"] + b["add"], "low": bounded(a["low"] + b["add"]), "high": bounded(a["high"] + b["add"])}


def term_runs(ratings: DataFrame, term: str, order: list[str], part: Column) -> DataFrame:
    """(term, add, low, high): what all ratings (term, positive), in order, do to a weight.

    A run of ratings acts on a weight as "add, then bound from below and above", and two such runs make another. So each
    part of a term's ratings (an ascending function of the order, such as the day) is folded on its own before parts meet.
    """
    step = F.when(F.col("positive"), F.lit(UP)).otherwise(F.lit(DOWN))
    one = F.struct(F.struct(*order).alias("at"), step.alias("add"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high"))

    def after(a: Column, b: Column) -> Column:
        return F.struct(*[c.alias(name) for name, c in composed(a, b).items()])

    none = F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"))
    parts = ratings.groupBy(term, part.alias("part")).agg(F.sort_array(F.collect_list(one)).alias("steps")).select(term, "part", F.aggregate("steps", none, after).alias("run"))
    runs = parts.groupBy(term).agg(F.sort_array(F.collect_list(F.struct("part", "run.add", "run.low", "run.high"))).alias("runs")).select(term, F.aggregate("runs", none, after).alias("run"))
    return runs.select(term, "run.*")


def weight(add: Column, low: Column, high: Column) -> Column:
    """The weight after a run, from the weight at first."""
    return F.round(F.least(high, F.greatest(low, F.lit(START) + add)), 6)


def term_weights(ratings: DataFrame, term: str, order: list[str], part: Column) -> DataFrame:
    """(term, weight): the weight after all ratings (term, positive) in order, kept within its bounds at each step."""
    return term_runs(ratings, term, order, part).select(term, weight(F.col("add"), F.col("low"), F.col("high")).alias("weight"))
