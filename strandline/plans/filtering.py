"""Filters, rules, patterns, further joins, aggregates and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import retrieval, set_join, vector_index
from .registry import ORACLES, query
from .searching import e05_question_answer_pairs
from .views import CHUNKS, LEXICAL_WEIGHT, METRICS, QUESTION_CLASSES, chunks, metrics, table

_PAIRS = f"p AS ({ORACLES['e05_question_answer_pairs']})"
WANTED = ["MIT", "GPL", "BSD"]
PHRASES = ["license", "warranty"]
TERMS = ["error", "code", "setting", "install", "connect", "motor"]


def _count(column: str, phrase: str) -> str:
    return f"((length({column}) - length(replace({column}, '{phrase}', ''))) // {len(phrase)})"


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#2', 'Brand#12', 'GENERAL', 'UNKNOWN') OR p_partkey % 10 = 0")
def f03_product_context(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(rules.product_context(F.col("p_brand"), F.col("p_partkey") % 10 == 0, "Brand#2", ["Brand#12"])).select("p_partkey")


_OWN = "regexp_extract_all(text, '[A-Z]{3,}')"


@query(f"SELECT doc_id FROM documents WHERE NOT (len({_OWN}) > 0 AND NOT list_has_any({_OWN}, {WANTED}))")
def f05_code_mismatch(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(~rules.mismatched_codes(F.col("text"), WANTED)).select("doc_id")


@query("SELECT doc_id FROM documents WHERE NOT greatest(" + ", ".join(_count("lower(text)", p) for p in PHRASES) + ") >= 2")
def f06_capability_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(~rules.lacks_capability(F.col("text"), PHRASES)).select("doc_id")


@query(f"""WITH {CHUNKS}, f AS (SELECT doc_id, source, contains(lower(text), 'license') AS excluded, similarity >= 0.25 AND NOT contains(lower(text), 'license') AS fit FROM chunks),
    g AS (SELECT source, count(*) FILTER (excluded) > 10 OR count(*) FILTER (fit) = 0 AS abort FROM f GROUP BY source) SELECT doc_id, source FROM f JOIN g USING (source) WHERE fit OR abort""")
def f07_relevance_rules(spark, sf_dir):
    """Irrelevant hits of a source go, unless more than ten would for their words, or nothing would stay."""
    out = F.lower("text").contains("license")
    f = chunks(spark, sf_dir).select("doc_id", "source", out.alias("excluded"), ((F.col("similarity") >= 0.25) & ~out).alias("fit"))
    g = f.groupBy("source").agg(((F.count_if("excluded") > 10) | (F.count_if("fit") == 0)).alias("abort"))
    return f.join(g, "source").filter("fit OR abort").select("doc_id", "source")


@query("""SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0, 1 - list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / 2), 6) AS score FROM embeddings e, embeddings q
    WHERE q.vec_id % 100 = 0 AND round(greatest(0, 1 - list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / 2), 6) >= 0.3""")
def f09_distance_threshold(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))  # a stated query set
    return vector_index.search(vector_index.build(e, "distance"), q, k=None, least=0.3, own=True)


@query(f"""WITH {_PAIRS} SELECT coalesce(CASE WHEN regexp_matches(answer, '(?i)\\b(see|apply) (the )?bulletin\\b') THEN 'bulletin' WHEN length(answer) <= 100 AND regexp_matches(answer, '(?i)\\b(thanks|thank you|closed|feedback)\\b') THEN 'feedback only'
    WHEN length(question) < 30 OR length(answer) < 30 THEN 'no content' END, 'accepted') AS reason, count(*) AS n FROM p GROUP BY 1""")
def f12_f13_funnel(spark, sf_dir):
    reason = F.coalesce(rules.reject_reason(F.col("question"), F.col("answer")), F.lit("accepted"))
    return e05_question_answer_pairs(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')"


@query(rf"""SELECT doc_id FROM documents WHERE length(text) > 0 AND length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) / length(text) <= 0.25
    AND (len({_WORDS}) < 15 OR len(list_filter({_WORDS}, lambda w: list_contains({rules.ENGLISH}, w))) / len({_WORDS}) >= 0.04)""")
def f16_english(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(rules.is_english(F.col("text"))).select("doc_id")


@query("SELECT page_id FROM pages WHERE octet_length(encode(html)) <= 4000")
def f17_request_size(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(F.octet_length("html") <= 4000).select("page_id")


_HIT = "contains(lower(text), '{}')::INT"


def _intent_list() -> str:
    rows = []
    for place, (name, phrases) in enumerate(rules.INTENTS.items()):
        n = " + ".join(_HIT.format(p) for p in phrases)
        length = " + ".join(f"{len(p)} * {_HIT.format(p)}" for p in phrases)
        rows.append(f"{{'name': '{name}', 'n': {n}, 'length': {length}, 'place': {place}}}")
    return "[" + ", ".join(rows) + "]"


@query(f"""WITH i AS (SELECT conv_id, turn, unnest({_intent_list()}) AS s FROM conversations), r AS (SELECT conv_id, turn, s.name AS name, s.n AS n, s.place AS place,
        row_number() OVER (PARTITION BY conv_id, turn ORDER BY s.n DESC, s.length DESC, s.place) AS rank FROM i WHERE s.n > 0),
    b AS (SELECT * FROM r WHERE rank = 1), o AS (SELECT conv_id, turn, arg_min(name, (-n, place)) AS name FROM r WHERE rank > 1 GROUP BY ALL)
    SELECT c.conv_id, c.turn, coalesce(b.name, 'general') AS intent, CASE WHEN b.n IS NULL THEN 0.5 ELSE round(least(0.95, 0.5 + 0.15 * b.n), 6) END::DOUBLE AS confidence, o.name AS secondary
    FROM conversations c LEFT JOIN b USING (conv_id, turn) LEFT JOIN o USING (conv_id, turn)""")
def c05_w07_intent(spark, sf_dir):
    i = table(spark, sf_dir, "conversations").select("conv_id", "turn", rules.keyword_intent(F.col("text")).alias("i"))
    return i.select("conv_id", "turn", "i.intent", F.round("i.confidence", 6).alias("confidence"), "i.secondary")


@query(f"SELECT conv_id, turn, {LEXICAL_WEIGHT} AS lexical, round(1 - {LEXICAL_WEIGHT}, 6) AS dense FROM conversations")
def c13_retrieval_weights(spark, sf_dir):
    w = rules.retrieval_weights(F.col("text"), QUESTION_CLASSES).alias("w")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", w).select("conv_id", "turn", "w.lexical", "w.dense")


_WORD = "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name || '!x' WHEN 2 THEN lower(c_mktsegment) ELSE c_mktsegment || c_custkey END"


@query(f"""WITH w AS (SELECT c_custkey, {_WORD} AS w FROM customer) SELECT c_custkey,
    array_to_string(list_filter([CASE WHEN length(w) < 12 THEN 'length' END, CASE WHEN NOT regexp_matches(w, '[A-Z]') THEN 'upper' END, CASE WHEN NOT regexp_matches(w, '[a-z]') THEN 'lower' END,
        CASE WHEN NOT regexp_matches(w, '[0-9]') THEN 'digit' END, CASE WHEN NOT regexp_matches(w, '[^A-Za-z0-9]') THEN 'special' END], lambda x: x IS NOT NULL), ',') AS errors,
    25 * (length(w) >= 12)::INT + 10 * (length(w) >= 16)::INT + 5 * (length(w) >= 20)::INT + 15 * regexp_matches(w, '[A-Z]')::INT + 15 * regexp_matches(w, '[a-z]')::INT
    + 15 * regexp_matches(w, '[0-9]')::INT + 20 * regexp_matches(w, '[^A-Za-z0-9]')::INT AS strength FROM w""")
def c14_password_policy(spark, sf_dir):
    i, name, segment = F.col("c_custkey") % 4, F.col("c_name"), F.col("c_mktsegment")
    w = F.when(i == 0, name).when(i == 1, F.concat(name, F.lit("!x"))).when(i == 2, F.lower(segment)).otherwise(F.concat(segment, F.col("c_custkey").cast("string")))
    words = table(spark, sf_dir, "customer").select("c_custkey", w.alias("w"))
    return words.select("c_custkey", F.array_join(rules.password_errors(F.col("w")), ",").alias("errors"), rules.password_strength(F.col("w")).alias("strength"))


_T = "CASE k % 3 WHEN 0 THEN 'from ' || k || ' to ' || (k + 5) || ' Nm' WHEN 1 THEN k || '.5 Nm - ' || (k + 9) || ' Nm' ELSE 'set ' || k || ' Nm' END"


@query(f"WITH {METRICS} SELECT event_id, k::DOUBLE + CASE k % 3 WHEN 1 THEN 0.5 ELSE 0 END AS low, (k + CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 9 ELSE 0 END)::DOUBLE AS high FROM metrics")
def x04_torque_range(spark, sf_dir):
    """Ranges read back from sentences made of each event's number."""
    k = F.col("k").cast("string")
    plus = lambda n: (F.col("k") + n).cast("string")
    said = F.when(F.col("k") % 3 == 0, F.concat(F.lit("from "), k, F.lit(" to "), plus(5), F.lit(" Nm"))).when(F.col("k") % 3 == 1, F.concat(k, F.lit(".5 Nm - "), plus(9), F.lit(" Nm"))).otherwise(F.concat(F.lit("set "), k, F.lit(" Nm")))
    return metrics(spark, sf_dir).select("event_id", rules.torque_range(said).alias("r")).select("event_id", "r.low", "r.high")


@query(f"""WITH {_PAIRS}, t AS (SELECT conv_id, turn, length(question) AS q, length(answer) AS a, {" + ".join(f"contains(lower(question || answer), '{t}')::INT" for t in TERMS)} AS n FROM p)
    SELECT conv_id, turn, round(least(1.0, 0.15 * (q >= 30)::INT + 0.1 * (q >= 50)::INT + 0.2 * (a >= 100)::INT + 0.15 * (a >= 200)::INT + 0.2 * (n > 0)::INT + least(n * 0.05, 0.2)), 6)::DOUBLE AS quality FROM t""")
def m17_ticket_quality(spark, sf_dir):
    return e05_question_answer_pairs(spark, sf_dir).select("conv_id", "turn", F.round(rules.ticket_quality(F.col("question"), F.col("answer"), TERMS), 6).alias("quality"))


@query(f"""WITH {CHUNKS} SELECT source, document_type, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM chunks GROUP BY ROLLUP (source, document_type)""")
def a19_ingest_totals(spark, sf_dir):
    return chunks(spark, sf_dir).rollup("source", "document_type").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""WITH {CHUNKS} SELECT count(*) AS total, count(*) FILTER (is_procedure) AS with_section, count(DISTINCT source) AS sources, round(count(*) FILTER (is_procedure) * 100.0 / count(*), 1) AS coverage FROM chunks""")
def a24_citation_summary(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.agg(F.count("*").alias("total"), F.count_if("is_procedure").alias("with_section"), F.count_distinct("source").alias("sources"), F.round(F.count_if("is_procedure") * 100.0 / F.count("*"), 1).alias("coverage"))


@query(f"""WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents), c AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL)
    SELECT doc_id, max(n) AS most, round(max(n) / sum(n), 6) AS share FROM c GROUP BY doc_id""")
def a26_word_repetition(spark, sf_dir):
    """The share of each text's most frequent word."""
    c = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.words(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    return c.groupBy("doc_id").agg(F.max("n").alias("most"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS issues
    FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY' ORDER BY c_custkey LIMIT 10""")
def a17_problem_rows(spark, sf_dir):
    issues = F.array_compact(F.array(F.when(F.col("c_acctbal") < 0, "negative"), F.when(F.col("c_mktsegment") == "MACHINERY", "segment")))
    found = table(spark, sf_dir, "customer").select("c_custkey", issues.alias("issues")).filter(F.size("issues") > 0)
    return found.orderBy("c_custkey").limit(10).select("c_custkey", F.array_join("issues", ",").alias("issues"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 'warm' WHEN p_name LIKE 'small%' THEN 'little' WHEN p_name LIKE 'blue%' THEN 'cold' WHEN p_name LIKE '%gear' THEN 'drive' WHEN p_name LIKE '%ring' THEN 'seal' ELSE 'none' END AS controller FROM part""")
def j10_pattern_join(spark, sf_dir):
    """Anchored patterns of a small rule table against each name; the first rule that fits."""
    rows = spark.createDataFrame([(0, "^red", "warm"), (1, "^small", "little"), (2, "^blue", "cold"), (3, "gear$", "drive"), (4, "ring$", "seal")], "place int, pattern string, controller string")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    hits = p.join(F.broadcast(rows), F.expr("p_name RLIKE pattern"), "left")
    first = hits.groupBy("p_partkey").agg(F.min_by("controller", "place").alias("c"))
    return first.select("p_partkey", F.coalesce("c", F.lit("none")).alias("controller"))


@query(f"""WITH {CHUNKS} SELECT doc_id, document_type, CASE document_type WHEN 'manual' THEN 'semantic' WHEN 'bulletin' THEN 'pairs' WHEN 'error_list' THEN 'entities' WHEN 'compatibility' THEN 'tables' ELSE 'hybrid' END AS strategy FROM chunks""")
def j13_strategy_lookup(spark, sf_dir):
    rows = spark.createDataFrame([("manual", "semantic"), ("bulletin", "pairs"), ("error_list", "entities"), ("compatibility", "tables")], "document_type string, strategy string")
    found = chunks(spark, sf_dir).join(F.broadcast(rows), "document_type", "left")
    return found.select("doc_id", "document_type", F.coalesce("strategy", F.lit("hybrid")).alias("strategy"))


_LEARNED = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-zçğıöşü]{3,}') AND NOT list_contains(" + str(text.STOP_WORDS) + ", w))"


@query(f"""WITH w AS (SELECT doc_id, unnest({_LEARNED}) AS word, generate_subscripts({_LEARNED}, 1) AS spot FROM documents), c AS (SELECT doc_id, word, count(*) AS n, min(spot) AS spot FROM w GROUP BY doc_id, word)
    SELECT doc_id, word, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, spot) AS rank FROM c) WHERE rank <= 10""")
def t04_learning_keywords(spark, sf_dir):
    """The ten commonest words of each text, earlier ones first among equals."""
    kept = F.filter(text.words(F.col("text")), lambda w: w.rlike("^[a-zçğıöşü]{3,}$") & ~w.isin(text.STOP_WORDS))
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(kept).alias("at", "word"))
    counted = w.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return retrieval.top(counted, ["doc_id"], [F.desc("n"), F.col("at")], 10).select("doc_id", "word", "n", "rank")


@query("SELECT doc_id, text AS decoded, text AS shifted FROM documents")
def t10_glyph_codes(spark, sf_dir):
    """Texts whose letter t was written as a glyph number, by its own code and by one that fonts number from 29 on; a number beyond ASCII goes."""
    said = lambda n: F.replace("text", F.lit("t"), F.lit(f"(cid:900)(cid:{n})"))
    return table(spark, sf_dir, "documents").select("doc_id", rules.cid_decoded(said(116)).alias("decoded"), rules.cid_decoded(said(87), 29).alias("shifted"))


@query(f"""WITH {CHUNKS}, r AS (SELECT doc_id, source, document_type, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, doc_id) AS rank FROM chunks)
    SELECT source, string_agg(rank || '. ' || document_type || ', Section ' || (doc_id % 9), chr(10) ORDER BY rank) AS citations FROM r WHERE rank <= 5 GROUP BY source""")
def t23_citation_list(spark, sf_dir):
    best = retrieval.top(chunks(spark, sf_dir), ["source"], [F.desc("similarity"), F.col("doc_id")], 5)
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.concat_ws(", ", "document_type", F.concat(F.lit("Section "), (F.col("doc_id") % 9).cast("string"))))
    lines = best.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))  # five
    return lines.select("source", F.array_join("l.line", "\n").alias("citations"))


@query(f"""WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, doc_id) AS rank FROM chunks WHERE length(text) > 0)
    SELECT source, string_agg('[' || document_type || ']' || CASE WHEN is_warning THEN ' !' ELSE '' END || ' ' || text, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 4 GROUP BY source""")
def t24_context_string(spark, sf_dir):
    best = retrieval.top(chunks(spark, sf_dir).filter(F.length("text") > 0), ["source"], [F.desc("similarity"), F.col("doc_id")], 4)
    line = F.concat(F.lit("["), F.col("document_type"), F.lit("]"), F.when(F.col("is_warning"), " !").otherwise(""), F.lit(" "), F.col("text"))
    lines = best.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))  # four
    return lines.select("source", F.array_join("l.line", "\n---\n").alias("context"))


@query(f"""WITH {CHUNKS}, r AS (SELECT doc_id, source, document_type, similarity, row_number() OVER (PARTITION BY source, document_type ORDER BY similarity DESC, doc_id) AS n FROM chunks)
    SELECT doc_id, source, document_type FROM r WHERE n <= 3 OR document_type <> 'bulletin'""")
def w02b_bulletin_limit(spark, sf_dir):
    """Three chunks of each source's bulletins at most; others all stay and skip the window's shuffle."""
    c = chunks(spark, sf_dir).select("doc_id", "source", "document_type", "similarity")
    some = retrieval.top(c.filter("document_type = 'bulletin'"), ["source"], [F.desc("similarity"), F.col("doc_id")], 3).drop("rank")
    return some.unionByName(c.filter("document_type <> 'bulletin'")).drop("similarity")


@query(f"""WITH {CHUNKS} SELECT doc_id, source, rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN document_type IN ('bulletin', 'guide') THEN 0 ELSE 1 END, similarity DESC, doc_id) AS rank FROM chunks) WHERE rank <= 8""")
def k03_two_key_sort(spark, sf_dir):
    first = F.when(F.col("document_type").isin("bulletin", "guide"), 0).otherwise(1)
    return retrieval.top(chunks(spark, sf_dir), ["source"], [first, F.desc("similarity"), F.col("doc_id")], 8).select("doc_id", "source", "rank")


@query("""SELECT source, min(doc_id) AS kept, count(*) AS copies, sha256(lower(text)) AS digest FROM documents GROUP BY source, sha256(lower(text)) HAVING count(*) > 1""")
def u10_content_copies(spark, sf_dir):
    digest = F.sha2(F.lower("text").cast("binary"), 256)
    return table(spark, sf_dir, "documents").groupBy("source", digest.alias("digest")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies")).filter("copies > 1")


@query(f"""WITH {METRICS} SELECT user_id, array_to_string(list_sort(list_intersect(a, b)), ',') AS both, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_first
    FROM (SELECT user_id, coalesce(list(DISTINCT k % 20) FILTER (event_type = 'view'), []) AS a, coalesce(list(DISTINCT k % 20) FILTER (event_type = 'purchase'), []) AS b FROM metrics GROUP BY user_id)""")
def u03_set_operations(spark, sf_dir):
    """Of the products a user viewed, those bought and those not; each set holds twenty at most."""
    kind, product = F.col("event_type"), F.col("k") % 20
    g = metrics(spark, sf_dir).groupBy("user_id").agg(F.collect_set(F.when(kind == "view", product)).alias("a"), F.collect_set(F.when(kind == "purchase", product)).alias("b"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return g.select("user_id", joined(F.array_intersect("a", "b")).alias("both"), joined(F.array_except("a", "b")).alias("only_first"))


@query()
def u05_greedy_near_duplicates(spark, sf_dir):
    """Of each source's texts, in order, those like none kept before (Jaccard over 0.85 of their words)."""
    rows = chunks(spark, sf_dir).select("doc_id", "source", "similarity", text.words(F.col("text")).alias("words"))
    return set_join.greedy_distinct(rows, "source", "doc_id", [-F.col("similarity"), F.col("doc_id")], "words", 0.85)


_LINKS = r"""list_sort(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1)))"""


@query(f"""SELECT page_id, l AS link, CASE WHEN l LIKE 'http%' THEN l WHEN l LIKE '//%' THEN 'https:' || l WHEN l LIKE '/%' THEN regexp_extract(url, '^(https?://[^/]+)', 1) || l
    ELSE regexp_extract(url, '^(https?://[^?#]*/)', 1) || l END AS absolute FROM (SELECT page_id, url, unnest({_LINKS}) AS l FROM pages)""")
def t21_absolute_links(spark, sf_dir):
    links = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))))
    p, link = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(links).alias("link")), F.col("link")
    host, folder = F.regexp_extract("url", "^(https?://[^/]+)", 1), F.regexp_extract("url", "^(https?://[^?#]*/)", 1)
    absolute = F.when(link.startswith("http"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(folder, link))
    return p.select("page_id", "link", absolute.alias("absolute"))
