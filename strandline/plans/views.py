"""Tables, and the views that give raw rows the columns which operators work on. SQL twins for DuckDB stand beside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ["manual", "bulletin", "guide", "procedure", "spec", "error_list", "compatibility", "general"]
AS_OF = "2024-01-31 00:00:00"
#: Classes of questions, by a pattern each, with the weight of words against vectors; made for the test tables' invented prose.
QUESTION_CLASSES = [("[A-Za-z][0-9]{2}", 0.6), ("(?i)thing|ment|zeit", 0.45)]
LEXICAL_WEIGHT = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN {w}" for p, w in QUESTION_CLASSES) + " ELSE 0.5 END::DOUBLE"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the metadata of chunks, derived from their ids."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (i % 8 + 1).cast("int"))
    return d.select("doc_id", "text", "lang", "source", "n_chars", kind.alias("document_type"), ((i % 10) / F.lit(10.0)).alias("importance"), (i % 7 == 0).alias("is_warning"), (i % 5 == 0).alias("is_procedure"), ((i * 37 % 101) / F.lit(100.0)).alias("similarity"))


TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"
CHUNKS = f"""chunks AS (
    SELECT doc_id, text, lang, source, n_chars, {TYPE_LIST}[(doc_id % 8 + 1)::INT] AS document_type,
           (doc_id % 10) / 10.0::DOUBLE AS importance, doc_id % 7 = 0 AS is_warning, doc_id % 5 = 0 AS is_procedure,
           (doc_id * 37 % 101) / 100.0::DOUBLE AS similarity
    FROM documents)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measured requests: latency, confidence, cache hits."""
    e = table(spark, sf_dir, "events")
    confidence = F.when(F.col("event_type") == "purchase", 0.9).when(F.col("event_type") == "click", 0.7).when(F.col("event_type") == "view", 0.5).otherwise(0.3)
    return e.select("event_id", "ts", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), F.round(F.col("value") * 100, 4).alias("latency"), confidence.alias("confidence"), (F.col("event_id") % 3 == 0).alias("cache_hit"))


METRICS = """metrics AS (
    SELECT event_id, ts, user_id, event_type, value, (props->>'$.k')::BIGINT AS k, round(value * 100, 4) AS latency,
           CASE event_type WHEN 'purchase' THEN 0.9 WHEN 'click' THEN 0.7 WHEN 'view' THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence,
           event_id % 3 = 0 AS cache_hit
    FROM events)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as positive and errors as negative ratings of one of twenty sources."""
    m = metrics(spark, sf_dir).filter(F.col("event_type").isin("purchase", "error"))
    return m.select("event_id", "ts", "user_id", F.concat(F.lit("src"), F.col("k") % 20).alias("source"), (F.col("event_type") == "purchase").alias("positive"))


FEEDBACK = METRICS + """, feedback AS (
    SELECT event_id, ts, user_id, 'src' || (k % 20) AS source, event_type = 'purchase' AS positive
    FROM metrics WHERE event_type IN ('purchase', 'error'))"""

#: The tokens of BM25 and of the evaluation in DuckDB.
BM25_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]{3,}'))"
EVAL_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '<[^>]*>', ' ', 'g'), '[^\p{L}\p{N}_\-]+'), lambda w: regexp_full_match(w, '[a-z][a-z0-9\-]+'))"


def structured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of documents as lines (doc_id, i, line) with headers, numbered steps, table rows, warnings, problems and prose before a
    blank line. No word is lost."""

    def planted(s, i):
        k = i % 10
        line = (
            F.when(k == 0, F.concat(F.lit("# "), s)).when(k <= 3, F.concat(k.cast("string"), F.lit(". "), s)).when(k <= 5, F.replace(s, F.lit(" "), F.lit(" | ")))
            .when(k == 6, F.concat(F.lit("WARNING: "), s)).when(k == 7, F.concat(F.lit("Problem: "), s)).when(k == 8, F.concat(F.lit("Solution: "), s)).otherwise(s)
        )
        return F.when(k == 9, F.array(line, F.lit(""))).otherwise(F.array(line))

    sentences = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ", -1)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.flatten(F.transform(sentences, planted))).alias("i", "line"))


LINES = """sentences AS (SELECT doc_id, unnest(string_split(replace(text, chr(10), ' '), '. ')) AS s, generate_subscripts(string_split(replace(text, chr(10), ' '), '. '), 1) - 1 AS i FROM documents),
    lines AS (SELECT doc_id, (i + i // 10)::INT AS i, CASE WHEN i % 10 = 0 THEN '# ' || s WHEN i % 10 <= 3 THEN (i % 10)::VARCHAR || '. ' || s WHEN i % 10 <= 5 THEN replace(s, ' ', ' | ')
        WHEN i % 10 = 6 THEN 'WARNING: ' || s WHEN i % 10 = 7 THEN 'Problem: ' || s WHEN i % 10 = 8 THEN 'Solution: ' || s ELSE s END AS line FROM sentences
        UNION ALL SELECT doc_id, (i + i // 10 + 1)::INT, '' FROM sentences WHERE i % 10 = 9)"""


def planted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id, text) of which each line's sentences became table rows, numbered steps or code entries, or stayed prose, by a
    checksum of the line. No word is lost."""
    sentences = lambda line: F.split(line, "(?<=[.]) ", -1)

    def planted(line):
        kind = F.pmod(F.crc32(line), F.lit(5))
        row = F.transform(sentences(line), lambda s: F.concat(F.lit("| "), F.replace(s, F.lit(" "), F.lit(" | ")), F.lit(" |")))
        step = F.transform(sentences(line), lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
        code = F.transform(sentences(line), lambda s, i: F.concat(F.lit("E0"), i + 10, F.lit(": "), s))
        return F.when(kind == 0, F.array_join(row, "\n")).when(kind == 1, F.array_join(step, "\n")).when(kind == 2, F.array_join(code, "\n")).otherwise(line)

    lines = F.split(F.replace("text", F.lit("|"), F.lit("/")), "\n", -1)
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(F.transform(lines, planted), "\n").alias("text"))
