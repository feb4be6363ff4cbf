"""Chunks, chunk types, checks of answers, prompts and event-time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chunking
from ..streaming.windows import window_metrics
from .registry import query
from .views import METRICS, metrics, table

#: Phrases that show an answer to be unsure, by family.
UNCERTAIN = [
    r"\b(might|may|could|possibly|probably|perhaps|maybe)\b",
    r"\b(i think|i believe|i assume|it seems|appears to be)\b",
    r"\b(not sure|uncertain|unclear|not certain)\b",
    r"\b(should be|would be|could be)\b",
    r"\b(likely|unlikely|potential|possible)\b",
    r"\b(olabilir|muhtemelen|belki|sanırım|gibi görünüyor)\b",
    r"\b(emin değilim|kesin değil|belirsiz)\b",
]
#: Unsure phrases of an answer that count as slight; later ones weigh more.
SLIGHT = 2
_PHRASES = "flatten([" + ", ".join(f"regexp_extract_all(lower(text), '{p}')" for p in UNCERTAIN) + "])"


def _phrases():
    return F.flatten(F.array(*[F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0)) for p in UNCERTAIN]))


@query(f"""WITH p AS (SELECT conv_id, turn, {_PHRASES} AS f FROM conversations)
    SELECT conv_id, turn, i AS ordinal, f[i] AS phrase, CASE WHEN i <= {SLIGHT} THEN 'low' ELSE 'medium' END AS severity
    FROM (SELECT *, unnest(generate_series(1, len(f))) AS i FROM p)""")
def r10_uncertain_phrases(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(_phrases()).alias("i", "phrase"))
    return found.select("conv_id", "turn", (F.col("i") + 1).cast("long").alias("ordinal"), "phrase", F.when(F.col("i") < SLIGHT, "low").otherwise("medium").alias("severity"))


@query(f"""SELECT conv_id, turn, CASE WHEN n = 0 THEN 'none' WHEN n >= {SLIGHT + 2} THEN 'high' WHEN n > {SLIGHT} THEN 'medium'
        WHEN least(n, {SLIGHT}) > 3 THEN 'medium' ELSE 'low' END AS severity
    FROM (SELECT conv_id, turn, len({_PHRASES}) AS n FROM conversations)""")
def r13_severity(spark, sf_dir):
    """High from two medium issues on, medium from one or from four low ones on; all of an answer's issues are in its row."""
    n = F.size(_phrases())
    low, medium = F.least(n, F.lit(SLIGHT)), F.greatest(n - SLIGHT, F.lit(0))
    level = F.when(n == 0, "none").when(medium >= 2, "high").when((medium > 0) | (low > 3), "medium").otherwise("low")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", level.alias("severity"))


@query()
def h02_word_windows(spark, sf_dir):
    return chunking.split_by_words(table(spark, sf_dir, "documents").select("doc_id", "text"), budget=400, overlap=80)


@query(f"""WITH {METRICS}, l AS (SELECT user_id, 'E' || lpad((k % 60)::VARCHAR, 3, '0') || ': ' || event_type AS line,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM metrics)
    SELECT user_id, place // 5 AS seq, string_agg(line, chr(10) ORDER BY place) AS chunk FROM l GROUP BY ALL""")
def h06_code_entries(spark, sf_dir):
    line = F.concat(F.lit("E"), F.lpad((F.col("k") % 60).cast("string"), 3, "0"), F.lit(": "), F.col("event_type"))
    return chunking.grouped_entries(metrics(spark, sf_dir), "user_id", ["event_id"], line)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS back FROM conversations),
    h AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || substr(text, 1, 500) || chr(10), '' ORDER BY back DESC)
          FILTER (back BETWEEN 2 AND 6) AS history, max(text) FILTER (back = 1) AS question FROM r WHERE back <= 6 GROUP BY conv_id)
    SELECT conv_id, '[Previous Conversation]' || chr(10) || coalesce(history, '') || chr(10) || '[Current Question]' || chr(10) || question AS prompt FROM h""")
def z09_conversation_prompt(spark, sf_dir):
    """The newest turn as the question, after the five before it; the window keeps six rows of a conversation."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), F.desc("text")))
    last = table(spark, sf_dir, "conversations").withColumn("back", back).filter("back <= 6")
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.substring("text", 1, 500), F.lit("\n"))
    lines = F.array_join(F.col("turns.line"), "")
    found = last.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("back") > 1, F.struct((-F.col("back")).alias("at"), line.alias("line"))))).alias("turns"),
        F.max(F.when(F.col("back") == 1, F.col("text"))).alias("question"),
    )
    return found.select("conv_id", F.concat(F.lit("[Previous Conversation]\n"), lines, F.lit("\n[Current Question]\n"), F.col("question")).alias("prompt"))


@query(f"""WITH {METRICS}, w AS (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start, latency FROM metrics)
    SELECT start, count(*) AS n, round(avg(latency), 4) AS mean_latency FROM w GROUP BY start""")
def z10_sliding_metrics(spark, sf_dir):
    return window_metrics(metrics(spark, sf_dir))
