"""What was learned so far, as stored partial states that batches of ratings are merged into.

A state has one row per key, and its values merge by an associative law (sums, or runs of bounded steps), so a batch is first aggregated
by itself and only the keys it has are merged, in the parts of the table these lie in. Each row names the last batch that changed it:
a batch that comes again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import learning
from ..sources.tables import shared_path, stored
from ..sources.versions import Versions

Values = dict[str, Column]


def summed(a: Values, b: Values) -> Values:
    return {c: a[c] + b[c] for c in a}


@dataclass(frozen=True)
class LearnedState:
    """keys and values of ``schema``, below ``path``; ``partial`` gives a batch's own state, ``merge`` the values of an earlier and a later one.
    Where the law depends on order, batches must come in that order. Null keys are keys like others."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: tuple[str, ...]
    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[Values, Values], Values] = summed
    parts: int = 16

    def table(self) -> Versions:
        held = StructType([StructField("id", StringType()), *self.schema.fields, StructField("batch", LongType())])
        return Versions(self.spark, self.path, held, "id", parts=self.parts)

    def fold(self, ratings: DataFrame, batch: int) -> None:
        """Merge a batch; numbers of batches ascend."""
        t = self.table()
        new = self.partial(ratings).withColumn("id", F.to_json(F.struct(*self.keys))).withColumn("batch", F.lit(batch).cast("long"))
        values = [f.name for f in self.schema.fields if f.name not in self.keys]

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            o, n = old.alias("o"), new.alias("n")
            both = self.merge({c: F.col(f"o.{c}") for c in values}, {c: F.col(f"n.{c}") for c in values})
            first, later = F.col("o.id").isNull(), F.col("n.batch") > F.col("o.batch")
            chosen = [F.when(first, F.col(f"n.{c}")).when(later, both[c]).otherwise(F.col(f"o.{c}")).alias(c) for c in values]
            named = [F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in ("id", *self.keys)]
            return o.join(n, F.col("o.id") == F.col("n.id"), "full").select(*named, *chosen, F.greatest("o.batch", "n.batch").alias("batch"))

        t.change(stored(new.select(*t.schema.names), "partial"), merged)

    def fold_stream(self, ratings: DataFrame, checkpoint: str) -> None:
        """Merge all that a stream has now; the next call with this checkpoint goes on where this one ended."""
        # batches of a stream are numbered from 0
        ratings.writeStream.foreachBatch(lambda df, i: self.fold(df, i + 1)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def read(self) -> DataFrame:
        return self.table().read().select(*self.schema.names)


def _counts(by: list[str]) -> Callable[[DataFrame], DataFrame]:
    return lambda r: r.groupBy(*by).agg(F.count_if("positive").alias("positive"), F.count("*").alias("n"))


def _state(spark: SparkSession, name: str, fields: str, keys: list[str], partial, merge=summed, path: str | None = None) -> LearnedState:
    schema = StructType.fromDDL(fields)
    return LearnedState(spark, path or shared_path(spark, name), schema, tuple(keys), partial, merge)


def source_counts(spark: SparkSession, path: str | None = None) -> LearnedState:
    """Of ratings (source, positive): positive and all ratings of each source."""
    return _state(spark, "source-counts", "source string, positive long, n long", ["source"], _counts(["source"]), path=path)


def mapping_counts(spark: SparkSession, path: str | None = None) -> LearnedState:
    """Of ratings (keywords, source, positive): positive and all ratings of each set of keywords and source."""
    partial = lambda r: _counts(["keywords", "source"])(r.withColumn("keywords", F.array_sort("keywords")))
    return _state(spark, "mapping-counts", "keywords array<string>, source string, positive long, n long", ["keywords", "source"], partial, path=path)


def term_runs(spark: SparkSession, order: list[str], part: Column, path: str | None = None) -> LearnedState:
    """Of ratings (keywords, positive), in batches that ascend in order: what they do to each term's weight."""
    partial = lambda r: learning.term_runs(r.withColumn("term", F.explode("keywords")), "term", order, part)
    return _state(spark, "term-runs", "term string, add double, low double, high double", ["term"], partial, learning.composed, path)


def mappings(counts: DataFrame) -> DataFrame:
    """The rows of ``mapping_counts`` as keyword mappings: successes, failures, rate, preferred and avoided sources."""
    good, bad = F.col("positive"), F.col("n") - F.col("positive")
    listed = lambda some: F.array_sort(F.collect_list(F.when(some > 0, F.col("source"))))
    found = counts.groupBy("keywords").agg(F.sum(good).alias("successes"), F.sum(bad).alias("failures"), listed(good).alias("preferred"), listed(bad).alias("avoided"))
    return found.withColumn("mapping", learning.mapping_key(F.col("keywords"))).withColumn("rate", F.round(F.col("successes") / (F.col("successes") + F.col("failures")), 6))
