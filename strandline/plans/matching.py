"""Many patterns, prefixes and names against texts. The patterns are words of the benchmark's texts, hundreds of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import patterns
from .registry import query
from .views import table

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"
_PATTERNS = f"""b AS (SELECT item_id, unnest(list_distinct({_WORDS})) AS pattern FROM benchmark), r AS (SELECT pattern, min(item_id) AS family FROM b WHERE length(pattern) >= 6 GROUP BY pattern),
    m AS (SELECT doc_id, pattern, family, (length(t) - length(replace(t, pattern, ''))) // length(pattern) AS n, instr(t, pattern) AS place FROM (SELECT doc_id, lower(text) AS t FROM documents), r WHERE contains(t, pattern))"""


def catalogue(spark, sf_dir):
    """pattern, family: words of six letters or more of the benchmark's texts, and the first item that has each."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(text.words(F.col("text"))).alias("pattern"))
    return words.filter(F.length("pattern") >= 6).groupBy("pattern").agg(F.min("item_id").alias("family"))


@query(f"WITH {_PATTERNS} SELECT doc_id, pattern, n, place FROM m")
def j18_many_substrings(spark, sf_dir):
    """Which of the patterns each document holds, how often and where first, in one pass over its text."""
    return patterns.substring_matches(table(spark, sf_dir, "documents"), "doc_id", F.lower("text"), catalogue(spark, sf_dir))


@query(f"""WITH {_PATTERNS}, f AS (SELECT doc_id, family, sum(n)::BIGINT AS n, count(*) AS forms, min(place) AS place FROM m GROUP BY doc_id, family)
    SELECT *, CASE WHEN n >= 10 THEN 0.95 ELSE 0.7 END::DOUBLE AS confidence, row_number() OVER (PARTITION BY doc_id ORDER BY place, family) = 1 AS first FROM f""")
def x06_many_mentions(spark, sf_dir):
    """Mentions of families, by any of a family's patterns; the family that is mentioned first is marked."""
    rules = catalogue(spark, sf_dir)
    found = patterns.substring_matches(table(spark, sf_dir, "documents"), "doc_id", F.lower("text"), rules).join(rules, "pattern")
    of = found.groupBy("doc_id", "family").agg(F.sum("n").alias("n"), F.count("*").alias("forms"), F.min("place").alias("place"))
    first = of.groupBy("doc_id").agg(F.min_by("family", F.struct("place", "family")).alias("head"))
    return of.join(first, "doc_id").select("doc_id", "family", "n", "forms", "place", F.when(F.col("n") >= 10, 0.95).otherwise(0.7).alias("confidence"), (F.col("family") == F.col("head")).alias("first"))


@query(f"""WITH b AS (SELECT unnest(list_distinct({_WORDS})) AS w FROM benchmark), r AS (SELECT DISTINCT w[1:n::INT] AS prefix FROM b, range(4, 7) g(n) WHERE length(w) >= 6),
    v AS (SELECT DISTINCT unnest({_WORDS}) AS word FROM documents)
    SELECT word, (SELECT max_by(prefix, length(prefix)) FROM r WHERE starts_with(word, prefix)) AS prefix FROM v""")
def j11_many_prefixes(spark, sf_dir):
    """The longest of the benchmark's word beginnings (four to six letters) that each word of the documents begins with."""
    words = table(spark, sf_dir, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).distinct()
    cut = F.explode(F.array(*[F.substring("pattern", 1, n) for n in (4, 5, 6)])).alias("prefix")
    rules = catalogue(spark, sf_dir).select(cut).distinct().withColumn("place", -F.length("prefix"))
    return patterns.first_prefix(words, "word", F.col("word"), rules, "prefix", "place")
