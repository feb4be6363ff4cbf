"""Scans, filters, joins, set operations and de-duplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import merging, retrieval, set_join
from .registry import query
from .views import CHUNKS, EVAL_TOKENS, FEEDBACK, chunks, feedback, table


@query("SELECT * FROM customer WHERE c_nationkey = 7 AND c_acctbal > 0")
def s01_collection_scan(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_nationkey = 7 AND c_acctbal > 0")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def s02_flagged_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""
    SELECT p_partkey, p_name FROM (
        SELECT *, row_number() OVER (ORDER BY CASE WHEN p_partkey = 77 THEN 0 ELSE 1 END, p_partkey) AS n
        FROM part WHERE p_partkey = 77 OR lower(p_name) = lower('PART 77')) WHERE n = 1""")
def s03_point_lookup(spark, sf_dir):
    """By key, else by name whatever its case: the first hit."""
    hits = table(spark, sf_dir, "part").filter("p_partkey = 77 OR lower(p_name) = lower('PART 77')")
    return hits.orderBy(F.when(F.col("p_partkey") == 77, 0).otherwise(1), "p_partkey").limit(1).select("p_partkey", "p_name")


@query(f"SELECT doc_id FROM (SELECT doc_id, {EVAL_TOKENS} AS t FROM documents) WHERE list_contains(t, 'license')")
def s04_array_contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.array_contains(text.eval_tokens(F.col("text")), "license")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE list_contains(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: lower(w)), lower('APACHE'))")
def s05_array_element_any_case(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.exists(F.split("text", r"\s+"), lambda w: F.lower(w) == "apache")).select("doc_id")


@query("SELECT doc_id, length(text) AS chars FROM documents")
def s07_full_scroll(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"))


def _upsert_sides(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    old = c.filter("c_custkey % 5 <> 0")
    name = F.when(F.col("c_custkey") % 4 == 0, "-").when(F.col("c_custkey") % 4 == 1, "").otherwise(F.concat("c_name", F.lit("*")))
    new = c.filter("c_custkey % 3 <> 0").select("c_custkey", name.alias("c_name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return old, new


_UPSERT = """
    WITH o AS (SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 5 <> 0),
    n AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '-' WHEN c_custkey % 4 = 1 THEN '' ELSE c_name || '*' END AS c_name,
                 CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS c_mktsegment, c_acctbal + 1 AS c_acctbal
          FROM customer WHERE c_custkey % 3 <> 0),
    m AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey,
                 CASE WHEN n.c_name IS NULL OR trim(n.c_name) IN ('', '-', 'N/A', 'Unknown') THEN o.c_name ELSE n.c_name END AS c_name,
                 CASE WHEN n.c_mktsegment IS NULL THEN o.c_mktsegment ELSE n.c_mktsegment END AS c_mktsegment,
                 CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE o.c_acctbal END AS c_acctbal,
                 CASE WHEN o.c_custkey IS NOT NULL AND n.c_custkey IS NOT NULL THEN 'updated'
                      WHEN n.c_custkey IS NOT NULL THEN 'inserted' ELSE 'kept' END AS action
          FROM o FULL JOIN n ON o.c_custkey = n.c_custkey)"""


@query(_UPSERT + " SELECT * FROM m")
def s16_smart_upsert(spark, sf_dir):
    return merging.smart_upsert(*_upsert_sides(spark, sf_dir), "c_custkey", forced=["c_acctbal"])


@query(_UPSERT + " SELECT action, count(*) AS n FROM m GROUP BY action")
def s17_upsert_stats(spark, sf_dir):
    return s16_smart_upsert(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query("""
    SELECT count(*) AS before, count(*) FILTER (length(text) < 50) AS purged, count(*) FILTER (length(text) >= 50) AS after FROM documents""")
def s22_quality_purge(spark, sf_dir):
    short = F.length("text") < 50
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("before"), F.count_if(short).alias("purged"), F.count_if(~short).alias("after"))


@query("SELECT count(*) AS points, min(len(embedding)) AS dims FROM embeddings")
def s28_collection_info(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.count("*").alias("points"), F.min(F.size("embedding")).cast("long").alias("dims"))


@query(f"WITH {CHUNKS} SELECT doc_id, document_type, importance FROM chunks WHERE document_type IN ('bulletin', 'guide') AND importance >= 0.5 AND is_procedure")
def f01_metadata_filter(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.filter(F.col("document_type").isin("bulletin", "guide") & (F.col("importance") >= 0.5) & F.col("is_procedure")).select("doc_id", "document_type", "importance")


@query(f"WITH {CHUNKS} SELECT doc_id, similarity FROM chunks WHERE lang = 'en' AND (source = 'src1' OR is_warning) AND similarity >= 0.3")
def f02_must_should_filter(spark, sf_dir):
    return chunks(spark, sf_dir).filter("lang = 'en' AND (source = 'src1' OR is_warning) AND similarity >= 0.3").select("doc_id", "similarity")


@query(f"""WITH {CHUNKS}, f AS (
    SELECT doc_id, similarity, CASE WHEN similarity < 0.25 THEN 'similarity' WHEN document_type = 'general' THEN 'type' ELSE 'kept' END AS reason FROM chunks)
    SELECT reason, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS share FROM f GROUP BY reason""")
def f08_filter_statistics(spark, sf_dir):
    """Rows per reason to exclude, the first that holds."""
    reason = F.when(F.col("similarity") < 0.25, "similarity").when(F.col("document_type") == "general", "type").otherwise("kept")
    counts = chunks(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))  # three rows
    return counts.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))


@query(f"""WITH {FEEDBACK}, bad AS (SELECT source FROM feedback GROUP BY source HAVING avg(positive::INT) < 0.5)
    SELECT doc_id, source FROM documents WHERE source <> 'src2' AND source NOT IN (SELECT source FROM bad)""")
def f10_excluded_sources(spark, sf_dir):
    bad = feedback(spark, sf_dir).groupBy("source").agg(F.avg(F.col("positive").cast("int")).alias("p")).filter("p < 0.5").select("source")
    return table(spark, sf_dir, "documents").filter("source <> 'src2'").join(bad, "source", "left_anti").select("doc_id", "source")


@query("""
    SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'price|order|invoice|discount|deliver|payment|refund') THEN 'commercial'
        WHEN regexp_matches(lower(text), 'weather|football|recipe|movie|politic|horoscope|lottery') THEN 'off_topic' WHEN length(text) < 30 THEN 'short' ELSE 'ok' END AS verdict
    FROM conversations WHERE role = 'user'""")
def f11_off_topic_guard(spark, sf_dir):
    low = F.lower("text")
    verdict = F.when(low.rlike("price|order|invoice|discount|deliver|payment|refund"), "commercial").when(low.rlike("weather|football|recipe|movie|politic|horoscope|lottery"), "off_topic").when(F.length("text") < 30, "short").otherwise("ok")
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", verdict.alias("verdict"))


_QUALITY = r"""CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) < 50 THEN 'short'
        WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) < 5 THEN 'few_words'
        WHEN (length(text) - length(replace(text, chr(10), ''))) / length(text)::DOUBLE > 0.15 THEN 'line_breaks'
        WHEN length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text)::DOUBLE > 0.7 THEN 'digits' ELSE 'good' END"""


@query(f"SELECT doc_id, {_QUALITY} AS verdict FROM documents")
def f15_chunk_quality(spark, sf_dir):
    t, n = F.col("text"), F.length("text")
    verdict = (
        F.when(F.trim(t) == "", "empty").when(n < 50, "short").when(text.word_count(t) < 5, "few_words")
        .when((n - F.length(F.replace(t, F.lit("\n"), F.lit("")))) / n > 0.15, "line_breaks")
        .when(F.length(F.regexp_replace(t, "[^0-9]", "")) / n > 0.7, "digits").otherwise("good")
    )
    return table(spark, sf_dir, "documents").select("doc_id", verdict.alias("verdict"))


@query(f"SELECT verdict, count(*) AS n FROM (SELECT {_QUALITY} AS verdict FROM documents) GROUP BY verdict")
def a18_quality_breakdown(spark, sf_dir):
    return f15_chunk_quality(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""WITH {FEEDBACK}, s AS (SELECT source, count(*) AS n, sum(positive::INT) AS p FROM feedback GROUP BY source)
    SELECT d.doc_id, round(CASE WHEN n IS NULL THEN 1.0 ELSE 0.5 + p / n::DOUBLE END, 6) AS boost FROM documents d LEFT JOIN s ON d.source = s.source""")
def j07_source_score(spark, sf_dir):
    s = feedback(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("positive").cast("int")).alias("p"))
    joined = table(spark, sf_dir, "documents").join(s, "source", "left")
    return joined.select("doc_id", F.round(F.when(F.col("n").isNull(), 1.0).otherwise(0.5 + F.col("p") / F.col("n")), 6).alias("boost"))


@query("""
    WITH fam(prefix, family, prio) AS (VALUES ('STANDARD', 'std', 1), ('PROMO', 'promo', 2), ('SMALL', 'small', 3), ('S', 'other_s', 4)),
    m AS (SELECT p_partkey, p_type, family, row_number() OVER (PARTITION BY p_partkey ORDER BY prio) AS n FROM part LEFT JOIN fam ON starts_with(p_type, prefix))
    SELECT p_partkey, p_type, coalesce(family, 'none') AS family FROM m WHERE n = 1""")
def j11_prefix_join(spark, sf_dir):
    """The family of the first prefix that a model begins with: a few rules, so a broadcast nested loop."""
    rules = spark.createDataFrame([("STANDARD", "std", 1), ("PROMO", "promo", 2), ("SMALL", "small", 3), ("S", "other_s", 4)], "prefix string, family string, prio int")
    hits = table(spark, sf_dir, "part").join(F.broadcast(rules), F.col("p_type").startswith(F.col("prefix")), "left")
    return retrieval.first_per_key(hits, ["p_partkey"], [F.col("prio")]).select("p_partkey", "p_type", F.coalesce("family", F.lit("none")).alias("family"))


@query("""
    WITH t(term) AS (VALUES ('license'), ('copyright'), ('password'))
    SELECT doc_id, term FROM documents JOIN t ON contains(lower(text), term)""")
def j18_substring_join(spark, sf_dir):
    terms = spark.createDataFrame([("license",), ("copyright",), ("password",)], "term string")
    return table(spark, sf_dir, "documents").join(F.broadcast(terms), F.contains(F.lower("text"), F.col("term"))).select("doc_id", "term")


@query("""
    SELECT s_suppkey AS id, s_name AS name, 'supplier' AS kind FROM supplier
    UNION ALL SELECT c_custkey, c_name, 'customer' FROM customer""")
def u01_tagged_union(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return s.unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("customer").alias("kind")))


@query("""
    SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS digest FROM documents
    QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id) = 1""")
def u04_normalised_dedup(spark, sf_dir):
    """The first document of each normalised text: one aggregation, no sort."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalised_space(F.col("text"))).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))


@query(f"""
    WITH b AS (SELECT item_id, list_sort(list_distinct({EVAL_TOKENS})) AS t FROM benchmark)
    SELECT x.item_id AS left_id, y.item_id AS right_id,
           round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t)))::DOUBLE, 6) AS likeness
    FROM b x JOIN b y ON x.item_id < y.item_id AND len(list_intersect(x.t, y.t)) > 0""")
def u06_pairwise_jaccard(spark, sf_dir):
    """Pairs that share a word, by a join on words: nothing is paired that shares none."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(text.eval_tokens(F.col("text"))).alias("t"))
    terms = b.select("item_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    x, y = terms.alias("x"), terms.alias("y")
    shared = x.join(y, (F.col("x.term") == F.col("y.term")) & (F.col("x.item_id") < F.col("y.item_id"))).groupBy(F.col("x.item_id").alias("left_id"), F.col("y.item_id").alias("right_id"), F.col("x.n").alias("a"), F.col("y.n").alias("b")).agg(F.count("*").alias("c"))
    return shared.select("left_id", "right_id", F.round(F.col("c") / (F.col("a") + F.col("b") - F.col("c")), 6).alias("likeness"))


_WORDS = r"list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}_]+'), lambda w: w <> '')))"


@query(f"""
    WITH d AS (SELECT doc_id, {_WORDS} AS t, len(t) AS n FROM documents),
    c AS (SELECT min(doc_id) AS id, t, n FROM d GROUP BY t, n),
    p AS (SELECT x.id AS left_id, y.id AS right_id, x.n + y.n AS total, len(list_intersect(x.t, y.t)) AS c
          FROM c x JOIN c y ON x.id < y.id AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n))
    SELECT left_id, right_id, round(c / (total - c)::DOUBLE, 6) AS likeness FROM p WHERE 5 * c >= 4 * (total - c)""")
def u06_similar_texts(spark, sf_dir):
    """Pairs of documents whose sets of words are alike by 0.8 or more; of equal sets the smallest id stands for all."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("words"))
    pairs, _ = set_join.similar_pairs(rows, "doc_id", "words", 0.8)
    return pairs.select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), F.round("likeness", 6).alias("likeness"))


@query("SELECT column_name, missing, empty, filled, round(filled * 100.0 / n, 1) AS fill_rate FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n, count(*) FILTER ({c} IS NULL) AS missing, count(*) FILTER ({c} IS NOT NULL AND trim({c}::VARCHAR) IN ('', '-', 'N/A', 'Unknown')) AS empty, count(*) FILTER ({c} IS NOT NULL AND trim({c}::VARCHAR) NOT IN ('', '-', 'N/A', 'Unknown')) AS filled FROM customer"
    for c in ("c_name", "c_mktsegment", "c_acctbal")) + ")")
def a15_field_completeness(spark, sf_dir):
    return merging.completeness(table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "c_acctbal"])


@query(f"""WITH {CHUNKS} SELECT doc_id, round((CASE WHEN importance >= 0.8 THEN 1.3 ELSE 1.0 END) * (CASE WHEN is_warning THEN 1.2 ELSE 1.0 END)
    * (CASE WHEN is_procedure THEN 1.15 ELSE 1.0 END) * (1 + 0.1 * (((length(text) - length(replace(text, 'the', ''))) // 3) % 4))::DOUBLE, 6) AS boost FROM chunks""")
def m06_metadata_boost(spark, sf_dir):
    hits = text.substring_count(F.col("text"), "the") % 4
    boost = scores.metadata_boost(F.col("importance"), F.col("is_warning"), F.col("is_procedure"), hits)
    return chunks(spark, sf_dir).select("doc_id", F.round(boost, 6).alias("boost"))
