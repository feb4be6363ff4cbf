"""Learning from ratings as they come: stored states that streams and batches are merged into."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores
from ..operators import learning
from ..sources.tables import shared_path
from ..streaming import learned_state
from .learning import rated
from .registry import ORACLES, query
from .views import AS_OF


def _in_two_runs(spark, sf_dir, state: learned_state.LearnedState) -> None:
    """Ratings arrive in a folder, even events first; a stream is run after either half, going on where it ended."""
    r = rated(spark, sf_dir)
    folder, checkpoint = shared_path(spark, "ratings"), shared_path(spark, "stream")
    for half in (0, 1):
        r.filter(F.col("event_id") % 2 == half).write.mode("append").parquet(folder)
        state.fold_stream(spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 256).parquet(folder), checkpoint)


@query(ORACLES["l01_source_scores"])
def l01_incremental_scores(spark, sf_dir):
    """Scores of sources from counters that a stream of ratings keeps."""
    state = learned_state.source_counts(spark)
    _in_two_runs(spark, sf_dir, state)
    n, p = F.col("n"), F.col("positive")
    wilson, score = F.round(scores.wilson_lower(p, n), 6), F.round(scores.learned_score(F.lit(1.0), p, n), 6)
    return state.read().select("source", n.alias("ratings"), "positive", wilson.alias("wilson"), score.alias("score"))


@query(ORACLES["l02_keyword_mappings"])
def l02_incremental_mappings(spark, sf_dir):
    """Keyword mappings from counters that a stream of ratings keeps."""
    state = learned_state.mapping_counts(spark)
    _in_two_runs(spark, sf_dir, state)
    m = learned_state.mappings(state.read())
    return m.select("mapping", "successes", "failures", "rate", F.array_join("preferred", ",").alias("preferred"), F.array_join("avoided", ",").alias("avoided"))


@query(ORACLES["m20_term_weights"])
def m20_incremental_weights(spark, sf_dir):
    """Weights of terms from the ratings of three spans of time, merged one after the other."""
    state = learned_state.term_runs(spark, ["ts", "event_id"], F.date_trunc("hour", "ts"))
    r, early, late = rated(spark, sf_dir), F.expr(f"timestamp '{AS_OF}' - INTERVAL 15 DAYS"), F.expr(f"timestamp '{AS_OF}' - INTERVAL 1 DAY")
    for batch, wanted in enumerate([F.col("ts") < early, (F.col("ts") >= early) & (F.col("ts") < late), F.col("ts") >= late], 1):
        state.fold(r.filter(wanted), batch)
    return state.read().select("term", learning.weight(F.col("add"), F.col("low"), F.col("high")).alias("weight"))
