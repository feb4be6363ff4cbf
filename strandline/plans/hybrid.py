"""Hybrid search: expansion, a lexical and a dense leg, fusion, boosts, re-ranking, context. A question's vector is the embedding of
its number, a document's that of its id."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules, scores, text
from ..operators import retrieval, text_index, vector_index
from ..sources.tables import stored
from .registry import query
from .searching import BM25_SQL
from .views import CHUNKS, FEEDBACK, LEXICAL_WEIGHT, QUESTION_CLASSES, chunks, feedback, table

#: Words and what may stand for them.
SYNONYMS = {"the": "that", "of": "from", "and": "with", "de": "la"}
_NORM = r"trim(regexp_replace(lower(text), '[^\p{L}\p{N}_\-]+', ' ', 'g'))"
_VARIANTS = ", ".join(f"replace(norm, ' {a} ', ' {b} ')" for a, b in SYNONYMS.items())
#: The first of equal strings stays where it is: list_distinct does not keep order.
EXPANDED = f"""normed AS (SELECT item_id, {_NORM} AS norm FROM benchmark),
    numbered AS (SELECT item_id, unnest([norm, {_VARIANTS}]) AS v, generate_subscripts([norm, {_VARIANTS}], 1) AS place FROM normed),
    expanded AS (SELECT item_id, string_agg(v, ' ' ORDER BY place) AS text, list(v ORDER BY place) AS variants
        FROM (SELECT item_id, v, min(place) AS place FROM numbered GROUP BY item_id, v QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY min(place)) <= 3) GROUP BY item_id)"""
WEIGHTS = f"weights AS (SELECT item_id, {LEXICAL_WEIGHT} AS lexical FROM benchmark)"
DENSE = """vq AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS q FROM benchmark JOIN embeddings ON vec_id = item_id),
    dense AS (SELECT query_id, doc_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM vq, embeddings JOIN documents ON vec_id = doc_id WHERE vec_id <> query_id),
    dense_top AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense QUALIFY rank <= 20)"""
CANDIDATES = f"""{EXPANDED}, {WEIGHTS}, {BM25_SQL.replace('FROM benchmark', 'FROM expanded')}, {DENSE}, {CHUNKS},
    fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, a.score AS lexical_score, b.score AS dense_score, a.rank AS lexical_rank, b.rank AS dense_rank
        FROM (SELECT * FROM bm25 WHERE rank <= 20) a FULL JOIN dense_top b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
    rrf AS (SELECT f.*, round(coalesce(lexical / (60 + lexical_rank), 0) + coalesce((1 - lexical) / (60 + dense_rank), 0), 8) AS rrf FROM fused f JOIN weights ON item_id = query_id),
    boosted AS (SELECT query_id, doc_id, source, document_type, c.text, importance, is_warning, is_procedure, lexical_score, dense_score, rrf, round(rrf * (CASE WHEN importance >= 0.8 THEN 1.3 ELSE 1.0 END) * (CASE WHEN is_warning THEN 1.2 ELSE 1.0 END) * (CASE WHEN is_procedure THEN 1.15 ELSE 1.0 END), 8) AS boosted
        FROM rrf JOIN chunks c USING (doc_id)),
    candidates AS (SELECT * FROM boosted QUALIFY row_number() OVER (PARTITION BY query_id, md5(text) ORDER BY boosted DESC, doc_id) = 1)"""


def expanded(spark, sf_dir):
    """item_id, variants (three at most), text: each question in its plain spelling, then with words replaced, without repeats."""
    norm = text.normalised_query(F.col("text"))
    b = table(spark, sf_dir, "benchmark").select("item_id", norm.alias("norm"))
    made = F.array("norm", *[F.replace("norm", F.lit(f" {a} "), F.lit(f" {b} ")) for a, b in SYNONYMS.items()])
    return b.select("item_id", F.slice(F.array_distinct(made), 1, 3).alias("variants")).withColumn("text", F.array_join("variants", " "))


def _dense(spark, sf_dir, k=20):
    e = table(spark, sf_dir, "embeddings")
    asked = table(spark, sf_dir, "benchmark").join(e, F.col("vec_id") == F.col("item_id")).select(F.col("item_id").alias("query_id"), F.col("embedding").alias("q"))
    held = e.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id")
    return vector_index.search(vector_index.build(held), asked, k).withColumnRenamed("vec_id", "doc_id")


def fused(spark, sf_dir):
    """query_id, doc_id, both legs' scores and ranks, and the fused score with the weights of the question's class."""
    lexical = text_index.search(text_index.build(table(spark, sf_dir, "documents")), expanded(spark, sf_dir).select(F.col("item_id").alias("query_id"), "text"), 20)
    both = lexical.withColumnsRenamed({"score": "lexical_score", "rank": "lexical_rank"}).join(_dense(spark, sf_dir).withColumnsRenamed({"score": "dense_score", "rank": "dense_rank"}), ["query_id", "doc_id"], "full")
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), rules.retrieval_weights(F.col("text"), QUESTION_CLASSES).alias("w"))
    part = lambda weight, rank: F.coalesce(weight / (60 + F.col(rank)), F.lit(0.0))
    return both.join(w, "query_id").withColumn("rrf", F.round(part(F.col("w.lexical"), "lexical_rank") + part(1 - F.col("w.lexical"), "dense_rank"), 8)).drop("w")


def candidates(spark, sf_dir):
    """The fused hits with their metadata and boosted score; of hits with one text the best."""
    c = chunks(spark, sf_dir).drop("similarity", "lang", "n_chars")
    boost = scores.metadata_boost(F.col("importance"), F.col("is_warning"), F.col("is_procedure"), F.lit(0))
    hits = fused(spark, sf_dir).join(c, "doc_id").withColumn("boosted", F.round(F.col("rrf") * boost, 8)).withColumn("digest", F.md5("text"))
    return retrieval.first_per_key(hits, ["query_id", "digest"], [F.desc("boosted"), F.col("doc_id")])


@query(f"WITH {EXPANDED} SELECT item_id, array_to_string(variants, '|') AS variants, len(variants) AS n FROM expanded")
def r04_expansion(spark, sf_dir):
    return expanded(spark, sf_dir).select("item_id", F.array_join("variants", "|").alias("variants"), F.size("variants").cast("long").alias("n"))


@query(f"WITH {DENSE} SELECT query_id, doc_id, score, rank FROM dense_top WHERE rank <= 10")
def r03_dense_store_search(spark, sf_dir):
    """The store's own hybrid search: the dense leg alone, whatever the weights."""
    return _dense(spark, sf_dir, 10).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {CANDIDATES} SELECT query_id, doc_id, lexical_score, dense_score, rrf FROM rrf")
def r05_j02_weighted_rrf(spark, sf_dir):
    """Both legs joined fully, with both scores, and their weighted reciprocal ranks."""
    return fused(spark, sf_dir).select("query_id", "doc_id", "lexical_score", "dense_score", "rrf")


@query(f"WITH {CANDIDATES} SELECT query_id, doc_id, boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, doc_id) AS rank FROM candidates QUALIFY rank <= 5")
def r06_hybrid_search(spark, sf_dir):
    """Every benchmark question: expanded, searched by words and by vectors, fused, boosted, without copies, the best five."""
    return retrieval.top(candidates(spark, sf_dir).select("query_id", "doc_id", "boosted"), ["query_id"], [F.desc("boosted"), F.col("doc_id")], 5)


_LEARNED = f"""{FEEDBACK}, {CANDIDATES}, learned AS (SELECT 'src' || (k % 20) AS source, avg((event_type = 'purchase')::INT) AS share FROM metrics WHERE event_type IN ('purchase', 'error') GROUP BY 1),
    reranked AS (SELECT c.*, round(boosted * CASE WHEN share > 0.52 THEN 1.25 WHEN share < 0.48 THEN 0.75 ELSE 1 END, 8) AS learned_score FROM candidates c LEFT JOIN learned USING (source))"""


def learned(spark, sf_dir):
    share = feedback(spark, sf_dir).groupBy("source").agg(F.avg(F.col("positive").cast("int")).alias("share"))
    factor = F.when(F.col("share") > 0.52, 1.25).when(F.col("share") < 0.48, 0.75).otherwise(1.0)
    return candidates(spark, sf_dir).join(share, "source", "left").withColumn("learned_score", F.round(F.col("boosted") * factor, 8))


@query(f"""WITH {_LEARNED}, kept AS (SELECT query_id, doc_id, source, learned_score, row_number() OVER (PARTITION BY query_id, source ORDER BY learned_score DESC, doc_id) AS of_source FROM reranked WHERE document_type <> 'general')
    SELECT query_id, doc_id, source, learned_score, row_number() OVER (PARTITION BY query_id ORDER BY learned_score DESC, doc_id) AS rank FROM kept WHERE of_source <= 2 QUALIFY rank <= 5""")
def r07_engine_retrieval(spark, sf_dir):
    """Candidates of fitting types with learned boosts, two of a source at most, the best five."""
    order = [F.desc("learned_score"), F.col("doc_id")]
    kept = retrieval.top(learned(spark, sf_dir).filter("document_type <> 'general'").select("query_id", "doc_id", "source", "learned_score"), ["query_id", "source"], order, 2).drop("rank")
    return retrieval.top(kept, ["query_id"], order, 5)


@query(f"WITH {_LEARNED} SELECT query_id, doc_id, boosted AS original_score, learned_score FROM reranked")
def r08_learned_ranking(spark, sf_dir):
    """Every candidate with the score it had and the one its source's ratings give it."""
    return learned(spark, sf_dir).select("query_id", "doc_id", F.col("boosted").alias("original_score"), "learned_score")


@query(f"""WITH {CANDIDATES}, s AS (SELECT query_id, doc_id, greatest(1, length(text) // 4) AS tokens, round(0.4 * coalesce(dense_score, 0) + 0.3 * importance + 0.15 * is_warning::INT + 0.1 * is_procedure::INT, 6) AS context_score FROM candidates),
    t AS (SELECT *, sum(tokens + 20) OVER (PARTITION BY query_id ORDER BY context_score DESC, doc_id) AS total FROM s),
    u AS (SELECT *, 3000 - (total - tokens - 20) - 20 AS room, sum((total > 3000)::INT) OVER (PARTITION BY query_id ORDER BY context_score DESC, doc_id) AS over_n FROM t)
    SELECT query_id, doc_id, context_score, CASE WHEN over_n = 1 THEN room ELSE tokens END::BIGINT AS taken_tokens, over_n = 1 AS truncated FROM u WHERE over_n = 0 OR (over_n = 1 AND total > 3000 AND room > 100)""")
def r09_context(spark, sf_dir):
    """Each question's candidates without copies, scored for the context and taken while their tokens fit."""
    s = scores.context_score(F.coalesce("dense_score", F.lit(0.0)), F.col("importance"), F.col("is_warning"), F.col("is_procedure"), F.lit(0))
    rows = candidates(spark, sf_dir).select("query_id", "doc_id", text.estimated_tokens(F.col("text")).alias("tokens"), F.round(s, 6).alias("context_score"))
    kept = retrieval.token_budget(rows, ["query_id"], [F.desc("context_score"), F.col("doc_id")], 3000)
    return kept.select("query_id", "doc_id", "context_score", F.col("taken_tokens").cast("long").alias("taken_tokens"), "truncated")


@query(f"""WITH {CANDIDATES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, doc_id) AS rank FROM candidates)
    SELECT query_id, source, rank AS first_rank, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS excerpt FROM r QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1""")
def r14_source_list(spark, sf_dir):
    """The sources of a question's hits, each with its best rank and the beginning of that text."""
    ranked = candidates(spark, sf_dir).withColumn("first_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("boosted"), "doc_id")))
    first = retrieval.first_per_key(ranked.select("query_id", "source", "first_rank", text.truncated(F.col("text"), 200).alias("excerpt")), ["query_id", "source"], [F.col("first_rank")])
    return first


# -- scores ------------------------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label FROM embeddings WHERE vec_id % 100 = 0)
    SELECT query_id, vec_id, round(least(1.0, list_cosine_similarity(embedding::DOUBLE[], q) + 0.05 * (vec_id % 3 = query_id % 3)::INT + 0.1 * (vec_id % 5 = query_id % 5)::INT + 0.15 * (e.label = q.label)::INT), 6) AS similarity FROM q, embeddings e WHERE vec_id <> query_id""")
def m04_domain_similarity(spark, sf_dir):
    """Cosine of a stated query set with all vectors, and steps for shared terms, codes and series, one at most."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))
    same = lambda n: (F.col("vec_id") % n == F.col("query_id") % n).cast("int")
    near = vector_index.search(vector_index.build(e, also=("label",)), q, k=None)
    score = F.col("score") + 0.05 * same(3) + 0.1 * same(5) + 0.15 * (F.col("label") == F.col("q_label")).cast("int")
    return near.select("query_id", "vec_id", F.round(F.least(F.lit(1.0), score), 6).alias("similarity"))


_GRAMS = "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))"
_TFIDF = rf"""b AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[a-z0-9]{{2,}}') AS t FROM benchmark), g AS (SELECT id, unnest({_GRAMS}) AS term FROM b), n AS (SELECT count(*) AS n FROM benchmark),
    tf AS (SELECT id, term, 1 + ln(count(*)) AS tf FROM g GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    w AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN df USING (term), n WHERE df <= 0.95 * n), l AS (SELECT id, sqrt(sum(w * w)) AS size FROM w GROUP BY id)"""


@query(f"""WITH {_TFIDF} SELECT x.id AS left_id, y.id AS right_id, round(sum(x.w * y.w) / (min(lx.size) * min(ly.size)), 6) AS cosine FROM w x JOIN w y ON x.term = y.term AND x.id < y.id JOIN l lx ON lx.id = x.id JOIN l ly ON ly.id = y.id GROUP BY x.id, y.id""")
def m05_tf_idf_cosine(spark, sf_dir):
    """Cosine of TF-IDF weights of one and two words (damped counts, smoothed rarity, terms of nearly all texts left out), by a join on terms."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{2,}"), F.lit(0)).alias("t"))
    pairs = F.zip_with(F.slice(F.col("t"), F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice(F.col("t"), F.lit(2), F.greatest(F.size("t") - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    tf = b.select("id", F.explode(F.concat("t", pairs)).alias("term")).groupBy("id", "term").agg((1 + F.log(F.count("*"))).alias("tf"))
    n = b.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    w = tf.join(df, "term").crossJoin(F.broadcast(n)).filter("df <= 0.95 * n").select("id", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    w = stored(w, "weights")
    size = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    x, y = (w.select(F.col("id").alias(f"{s}_id"), "term", F.col("w").alias(f"{s}_w")) for s in ("left", "right"))
    dots = x.join(y, "term").filter("left_id < right_id").groupBy("left_id", "right_id").agg(F.sum(F.col("left_w") * F.col("right_w")).alias("dot"))
    sizes = [size.select(F.col("id").alias(f"{s}_id"), F.col("size").alias(f"{s}_size")) for s in ("left", "right")]
    found = dots.join(sizes[0], "left_id").join(sizes[1], "right_id")
    return found.select("left_id", "right_id", F.round(F.col("dot") / (F.col("left_size") * F.col("right_size")), 6).alias("cosine"))


_FACTORS = "CASE document_type WHEN 'bulletin' THEN 2.5 WHEN 'guide' THEN 2.0 WHEN 'manual' THEN 1.5 ELSE 1.0 END::DOUBLE"
_CODES = "regexp_extract_all(upper(text), '[A-Z]{1,3}-?[0-9]{2,4}')"


@query(f"""WITH {CHUNKS}, c AS (SELECT *, {_CODES} AS codes, (contains(text, 'tion the'))::INT + (contains(text, ' of the '))::INT + (contains(text, ' and the '))::INT AS phrases,
        len(list_filter(['thing', 'thou', 'ment', 'eau'], lambda w: contains(lower(text), w))) AS words FROM chunks)
    SELECT doc_id, round(similarity * {_FACTORS} * CASE WHEN is_procedure THEN 1.3 ELSE 1.0 END * CASE WHEN is_warning THEN 1.2 ELSE 1.0 END * (1 + 0.3 * importance), 6) AS engine_score,
        CASE WHEN contains(upper(source), 'SRC1') THEN 2.5 WHEN len(codes) > 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS code_boost,
        round(least(4.0, CASE WHEN phrases >= 3 THEN 2.5 WHEN phrases = 2 THEN 2.0 WHEN phrases = 1 THEN 1.5 ELSE 1.0 END * CASE WHEN words >= 3 THEN 1.5 WHEN words >= 2 THEN 1.3 ELSE 1.0 END), 6)::DOUBLE AS phrase_boost,
        round(similarity * CASE WHEN starts_with(source, 'src1') THEN 1.2 ELSE 1.0 END * least(2.5, CASE WHEN words > 0 THEN 1.5 + 0.2 * words ELSE 1.0 END), 6)::DOUBLE AS legacy_score,
        round(similarity * {_FACTORS} * CASE WHEN document_type = 'bulletin' THEN 1.5 ELSE 1.0 END * CASE WHEN is_procedure THEN 1.2 ELSE 1.0 END * CASE WHEN regexp_matches(text, '[|].*[|]') THEN 1.3 ELSE 1.0 END, 6) AS strategy_score FROM c""")
def m07_m08_m09_m10_m11_boosts(spark, sf_dir):
    """Five boosts of a base score: by metadata, codes, phrases, the older rules, and the strategy."""
    c, low = chunks(spark, sf_dir), F.lower("text")
    kind = F.col("document_type")
    factor = F.when(kind == "bulletin", 2.5).when(kind == "guide", 2.0).when(kind == "manual", 1.5).otherwise(1.0)
    on = lambda cond, x: F.when(cond, x).otherwise(1.0)
    count = lambda col, terms: sum((F.contains(col, F.lit(t)).cast("int") for t in terms), F.lit(0))
    phrases, words = count(F.col("text"), ["tion the", " of the ", " and the "]), count(low, ["thing", "thou", "ment", "eau"])
    coded = F.size(F.regexp_extract_all(F.upper("text"), F.lit("[A-Z]{1,3}-?[0-9]{2,4}"), F.lit(0))) > 0
    by_phrase = F.when(phrases >= 3, 2.5).when(phrases == 2, 2.0).when(phrases == 1, 1.5).otherwise(1.0) * F.when(words >= 3, 1.5).when(words >= 2, 1.3).otherwise(1.0)
    r = lambda x: F.round(x, 6)
    return c.select(
        "doc_id",
        r(F.col("similarity") * factor * on(F.col("is_procedure"), 1.3) * on(F.col("is_warning"), 1.2) * (1 + 0.3 * F.col("importance"))).alias("engine_score"),
        F.when(F.upper("source").contains("SRC1"), 2.5).when(coded, 2.0).otherwise(1.0).alias("code_boost"),
        r(F.least(F.lit(4.0), by_phrase)).alias("phrase_boost"),
        r(F.col("similarity") * on(F.col("source").startswith("src1"), 1.2) * F.least(F.lit(2.5), F.when(words > 0, 1.5 + 0.2 * words).otherwise(1.0))).alias("legacy_score"),
        r(F.col("similarity") * factor * on(kind == "bulletin", 1.5) * on(F.col("is_procedure"), 1.2) * on(F.col("text").rlike("[|].*[|]"), 1.3)).alias("strategy_score"),
    )


@query(f"""WITH {CHUNKS}, s AS (SELECT source, avg(similarity) AS a, max(similarity) AS m, count(*) AS n, min(document_type) AS intent, avg((length(text) > 200)::INT) AS said FROM chunks GROUP BY source),
    c AS (SELECT source, intent, round(0.35 * (0.5 * least(a / 0.5, 1) + 0.5 * least(n / 5.0, 1)) + 0.25 * m + 0.25 * said + 0.15 * (0.5 * least(a / 0.5, 1) + 0.3 * least(m / 0.6, 1) + 0.2 * least(n / 3.0, 1)), 6) AS confidence FROM s)
    SELECT source, confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= CASE WHEN intent = 'bulletin' THEN 0.5 ELSE 0.6 END THEN 'medium' ELSE 'low' END AS level FROM c""")
def m14_confidence(spark, sf_dir):
    """Sources, intent, response and context weighed together; the level's threshold depends on the intent."""
    s = chunks(spark, sf_dir).groupBy("source").agg(F.avg("similarity").alias("a"), F.max("similarity").alias("m"), F.count("*").alias("n"), F.min("document_type").alias("intent"), F.avg((F.length("text") > 200).cast("int")).alias("said"))
    one = F.lit(1.0)
    sources = 0.5 * F.least(F.col("a") / 0.5, one) + 0.5 * F.least(F.col("n") / 5, one)
    total = 0.35 * sources + 0.25 * F.col("m") + 0.25 * F.col("said") + 0.15 * scores.sufficiency(F.col("a"), F.col("m"), F.col("n"))
    c = s.select("source", "intent", F.round(total, 6).alias("confidence"))
    level = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= F.when(F.col("intent") == "bulletin", 0.5).otherwise(0.6), "medium").otherwise("low")
    return c.select("source", "confidence", level.alias("level"))


@query("""WITH s AS (SELECT p_partkey, p_size AS value, p_size % 4 AS major, p_size % 9 AS minor, 5 AS low, 45 AS high, p_brand IN ('Brand#1', 'Brand#2') AS known FROM part),
    v AS (SELECT *, CASE WHEN value < low OR value > high THEN 'block' WHEN value > 0.9 * high THEN 'warn' ELSE 'ok' END AS range_status,
        CASE WHEN major > 2 OR (major = 2 AND minor >= 5) THEN 'ok' WHEN major = 2 THEN 'warn' ELSE 'block' END AS version_status, CASE WHEN known THEN 'ok' ELSE 'warn' END AS product_status FROM s)
    SELECT p_partkey, range_status, version_status, product_status, CASE WHEN 'block' IN (range_status, version_status) THEN 'block' WHEN 'warn' IN (range_status, version_status, product_status) THEN 'warn' ELSE 'ok' END AS status,
        round(greatest(0.0, least(1.0, 0.7 + (range_status = 'ok')::INT * 0.05 + (range_status = 'warn')::INT * -0.1 + (range_status = 'block')::INT * -0.3 + (version_status = 'ok')::INT * 0.05 + (version_status = 'warn')::INT * -0.1 + (version_status = 'block')::INT * -0.3
            + (product_status = 'ok')::INT * 0.05 + (product_status = 'warn')::INT * -0.1)), 6)::DOUBLE AS confidence,
        round(least(0.85, 0.3 + 0.1 * ((value > 0)::INT + (minor > 0)::INT + known::INT)), 6)::DOUBLE AS extraction FROM v""")
def m18_m19_validation(spark, sf_dir):
    """Values against their range, versions part by part against the least, products against the known; the worst decides."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("value"), F.concat_ws(".", F.col("p_size") % 4, F.col("p_size") % 9).alias("version"), F.col("p_brand").isin("Brand#1", "Brand#2").alias("known"))
    part = rules.version_parts(F.col("version"), 3)
    least = rules.version_parts(F.lit("2.5"), 3)
    statuses = {
        "range_status": F.when(~F.col("value").between(5, 45), "block").when(F.col("value") > 0.9 * 45, "warn").otherwise("ok"),
        "version_status": F.when(part >= least, "ok").when(F.get(part, F.lit(0)) == 2, "warn").otherwise("block"),
        "product_status": F.when(F.col("known"), "ok").otherwise("warn"),
    }
    v = p.withColumns(statuses)
    every = F.array(*statuses)
    step = sum((F.when(F.col(c) == "ok", 0.05).when(F.col(c) == "warn", -0.1).otherwise(-0.3) for c in statuses), F.lit(0.7))
    status = F.when(F.array_contains(every, "block"), "block").when(F.array_contains(every, "warn"), "warn").otherwise("ok")
    filled = (F.col("value") > 0).cast("int") + (F.col("value") % 9 > 0).cast("int") + F.col("known").cast("int")
    return v.select("p_partkey", *statuses, status.alias("status"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), step)), 6).alias("confidence"), F.round(F.least(F.lit(0.85), 0.3 + 0.1 * filled), 6).alias("extraction"))
