"""Text functions, retrieval, ranking, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import text_index, vector_index
from ..operators.retrieval import term_frequencies
from ..sources.tables import stored
from .registry import query
from .views import BM25_TOKENS, CHUNKS, EVAL_TOKENS, chunks, table

_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"
_KEYWORDS = f"list_sort(list_distinct(list_filter({EVAL_TOKENS}, lambda w: length(w) >= 4 AND NOT list_contains({_STOP}, w))))"
BM25_SQL = _BM25 = f"""
    d AS (SELECT doc_id, {BM25_TOKENS} AS t FROM documents),
    n AS (SELECT count(*) AS n, avg(len(t)) AS average FROM d),
    tf AS (SELECT doc_id, len(t) AS dl, term, count(*) AS tf FROM (SELECT doc_id, t, unnest(t) AS term FROM d) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT item_id, unnest({BM25_TOKENS}) AS term FROM benchmark),
    b AS (SELECT item_id AS query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / average))), 6) AS score
          FROM q JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
    bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0)"""


def _doc(column, name="value"):
    return lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", column.alias(name))


@query(f"SELECT doc_id, {BM25_TOKENS} AS value FROM documents")
def t01_bm25_tokens(spark, sf_dir):
    return _doc(text.bm25_tokens(F.col("text")))(spark, sf_dir)


@query(f"SELECT doc_id, {EVAL_TOKENS} AS value FROM documents")
def t02_eval_tokens(spark, sf_dir):
    return _doc(text.eval_tokens(F.col("text")))(spark, sf_dir)


@query(f"SELECT doc_id, {_KEYWORDS} AS value FROM documents")
def t03_keyword_set(spark, sf_dir):
    return _doc(text.keyword_set(F.col("text")))(spark, sf_dir)


@query(r"SELECT item_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}_\-]+', ' ', 'g')) AS value FROM benchmark")
def t05_query_normalise(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", text.normalised_query(F.col("text")).alias("value"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS value FROM documents")
def t06_space_normalise(spark, sf_dir):
    return _doc(text.normalised_space(F.col("text")))(spark, sf_dir)


@query(r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(replace(text, chr(13) || chr(10), chr(10)), '\n[ \t]*\n+'),
    lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)) AS value FROM documents""")
def t07_paragraph_clean(spark, sf_dir):
    return _doc(text.cleaned_paragraphs(F.col("text")))(spark, sf_dir)


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g')) AS value FROM documents")
def t08_chunk_clean(spark, sf_dir):
    return _doc(text.cleaned_chunk(F.col("text")))(spark, sf_dir)


def _noise_sql() -> str:
    sql = "text"
    for p in text.NOISE:
        sql = f"regexp_replace({sql}, '{p}', ' ', 'g')"
    return f"trim(regexp_replace({sql}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_noise_sql().replace('text', 'html')} AS value FROM pages")
def t09_noise_removal(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.without_noise(F.col("html")).alias("value"))


@query(r"""SELECT doc_id, greatest(1, length(text) // 4) AS tokens, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words, length(text) AS chars,
    (length(text) - length(replace(text, 'th', ''))) // 2 AS hits FROM documents""")
def t14_t15_t16_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens(t).alias("tokens"), text.word_count(t).alias("words"), F.length(t).cast("long").alias("chars"), text.substring_count(t, "th").alias("hits"))


@query("""SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 120) || '...' ELSE text END AS cut,
    CASE WHEN length(text) <= 200 THEN text WHEN contains(substr(text, 1, 200), '.') AND 200 - instr(reverse(substr(text, 1, 200)), '.') + 1 > 100
         THEN substr(text, 1, 200 - instr(reverse(substr(text, 1, 200)), '.') + 1) ELSE substr(text, 1, 200) END AS sentence FROM documents""")
def t17_t18_truncation(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(t, 120).alias("cut"), text.sentence_truncated(t, 200).alias("sentence"))


@query(r"""SELECT doc_id, CASE WHEN regexp_extract(upper(text), 'E[ \-]?0*([0-9]{1,4})', 1) <> '' THEN 'E' || regexp_extract(upper(text), 'E[ \-]?0*([0-9]{1,4})', 1) END AS code FROM documents""")
def t19_error_code(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.error_code(F.col("text")).alias("code"))


_LANG = r"regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')"


@query("WITH c AS (SELECT doc_id, " + ", ".join(f"len(list_filter({_LANG}, lambda w: w IN ({', '.join(repr(x) for x in ws)}))) AS {n}" for n, ws in text.LANGUAGE_WORDS.items()) + """ FROM documents)
    SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN 'unknown' WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en'
        WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS value FROM c""")
def c08_language(spark, sf_dir):
    return _doc(text.language(F.col("text")))(spark, sf_dir)


@query(r"""WITH s AS (SELECT p_partkey, p_name || '. Torque: ' || p_size || ' to ' || (p_size + 10) || ' Nm. Size ' || p_size || ' mm' AS t FROM part),
    m AS (SELECT p_partkey, unnest(regexp_extract_all(t, '([0-9]+(?:\.[0-9]+)?) ?(Nm|kg|mm|rpm|V|A)')) AS m FROM s)
    SELECT p_partkey, regexp_extract(m, '^([0-9.]+)', 1)::DOUBLE AS value, regexp_extract(m, '([A-Za-z]+)$', 1) AS unit FROM m""")
def x12_measures(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    spec = F.concat("p_name", F.lit(". Torque: "), "p_size", F.lit(" to "), F.col("p_size") + 10, F.lit(" Nm. Size "), "p_size", F.lit(" mm"))
    return p.select("p_partkey", F.explode(text.measures(spec)).alias("m")).select("p_partkey", "m.value", "m.unit")


@query(r"""SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)) AS heading,
    coalesce(nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1)), ''), nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), 'untitled') AS name FROM pages""")
def x02_page_title(spark, sf_dir):
    title, heading = (F.trim(F.regexp_extract("html", p, 1)) for p in ("<title>([^<]*)</title>", "<h1[^>]*>([^<]*)</h1>"))
    empty = lambda c: F.when(c != "", c)
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), heading.alias("heading"), F.coalesce(empty(heading), empty(title), F.lit("untitled")).alias("name"))


@query(f"""WITH d AS (SELECT doc_id, {BM25_TOKENS} AS t FROM documents)
    SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, unnest(t) AS term, 1 AS x FROM d), (SELECT 1 AS y) GROUP BY term""".replace("count(*) AS df, sum(tf)::BIGINT AS cf", "count(DISTINCT doc_id) AS df, sum(x)::BIGINT AS cf"))
def a01_term_frequencies(spark, sf_dir):
    return term_frequencies(table(spark, sf_dir, "documents"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 10")
def r01_bm25_top_k(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return text_index.search(text_index.build(table(spark, sf_dir, "documents")), queries, 10)


_DENSE = """
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
    dense AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM q, embeddings WHERE vec_id <> query_id)"""


@query(f"WITH {_DENSE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM dense WHERE score >= 0.3) WHERE rank <= 10")
def r02_dense_top_k(spark, sf_dir):
    """A stated set of query vectors, one in a hundred, against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return vector_index.search(vector_index.build(e), queries, 10, least=0.3)


@query(f"""WITH {CHUNKS} SELECT source, round(0.5 * least(avg(similarity) / 0.5, 1) + 0.3 * least(max(similarity) / 0.6, 1) + 0.2 * least(count(*) / 3.0, 1), 6) AS score,
    CASE WHEN 0.5 * least(avg(similarity) / 0.5, 1) + 0.3 * least(max(similarity) / 0.6, 1) + 0.2 * least(count(*) / 3.0, 1) >= 0.7 THEN 'answer'
         WHEN 0.5 * least(avg(similarity) / 0.5, 1) + 0.3 * least(max(similarity) / 0.6, 1) + 0.2 * least(count(*) / 3.0, 1) >= 0.4 THEN 'caution' ELSE 'refuse' END AS advice
    FROM chunks GROUP BY source""")
def m13_sufficiency(spark, sf_dir):
    g = chunks(spark, sf_dir).groupBy("source").agg(F.avg("similarity").alias("a"), F.max("similarity").alias("t"), F.count("*").alias("n"))
    score = scores.sufficiency(F.col("a"), F.col("t"), F.col("n"))
    return g.select("source", F.round(score, 6).alias("score"), scores.recommendation(score).alias("advice"))


@query(f"""WITH {_BM25}, h AS (SELECT * FROM bm25 WHERE rank <= 5),
    k AS (SELECT item_id, {_KEYWORDS} AS kw FROM benchmark), t AS (SELECT doc_id, {_KEYWORDS} AS dk FROM documents),
    o AS (SELECT query_id, doc_id, round(CASE WHEN len(kw) = 0 THEN 0 ELSE len(list_intersect(kw, dk)) / len(kw)::DOUBLE END, 6) AS overlap
          FROM h JOIN k ON item_id = query_id JOIN t USING (doc_id))
    SELECT query_id, max(overlap) AS best, round(avg(overlap), 6) AS mean, CASE WHEN max(overlap) >= 0.15 THEN 'good' WHEN max(overlap) >= 0.07 THEN 'partial' ELSE 'fail' END AS grade
    FROM o GROUP BY query_id""")
def e01_e04_keyword_overlap(spark, sf_dir):
    """How much of each question's keywords its five BM25 hits hold, and the grade."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    hits = r01_bm25_top_k(spark, sf_dir).filter("rank <= 5")
    asked = b.select(F.col("item_id").alias("query_id"), text.keyword_set(F.col("text")).alias("kw"))
    found = stored(hits.select("query_id", "doc_id"), "hits").join(d, "doc_id").join(asked, "query_id").withColumn("dk", text.keyword_set(F.col("text")))
    overlap = F.when(F.size("kw") == 0, 0.0).otherwise(F.round(F.size(F.array_intersect("kw", "dk")) / F.size("kw"), 6))
    g = found.select("query_id", overlap.alias("o")).groupBy("query_id").agg(F.max("o").alias("best"), F.round(F.avg("o"), 6).alias("mean"))
    return g.withColumn("grade", scores.grade(F.col("best")))


@query(f"WITH {CHUNKS} SELECT doc_id, round(0.4 * similarity + 0.3 * importance + 0.15 * is_warning::INT + 0.1 * is_procedure::INT + 0.05 * (doc_id % 3), 6) AS score FROM chunks")
def m12_context_score(spark, sf_dir):
    s = scores.context_score(F.col("similarity"), F.col("importance"), F.col("is_warning"), F.col("is_procedure"), F.col("doc_id") % 3)
    return chunks(spark, sf_dir).select("doc_id", F.round(s, 6).alias("score"))


@query("""SELECT conv_id, turn, text AS question, lead AS answer FROM (SELECT *, lead(text) OVER w AS lead, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    WHERE role = 'user' AND next_role = 'assistant' AND length(lead) >= 50""")
def e05_question_answer_pairs(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return rows.filter("role = 'user' AND next_role = 'assistant' AND length(answer) >= 50").select("conv_id", "turn", F.col("text").alias("question"), "answer")
