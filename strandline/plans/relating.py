"""Lookups, self-joins, theta joins, ordered distinct rows, templates, tickets and resets, each with its oracle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import merging, quantiles, retrieval
from ..sources.tables import stored
from ..streaming.windows import first_of_each
from .analytics import now
from .chunks import TYPED, lines
from .classifying import _SPEC, spec_texts
from .registry import query
from .views import AS_OF, EVAL_TOKENS, FEEDBACK, METRICS, feedback, metrics, table

T = f"TIMESTAMP '{AS_OF}'"


# -- joins -------------------------------------------------------------------------------------------------------------------

_RETRIES = """o AS (SELECT event_id, user_id, ts, value, lag(event_id) OVER w AS retry_of, lag(ts) OVER w AS before FROM events WHERE event_type IN ('view', 'error') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def retries(spark, sf_dir):
    """Views and errors; one within an hour of the user's last one is its retry."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").filter("event_type IN ('view', 'error')").select("event_id", "user_id", "ts", "value")
    near = F.lag("ts").over(w) >= F.col("ts") - F.expr("INTERVAL 1 HOUR")
    return e.withColumn("retry_of", F.when(near, F.lag("event_id").over(w))).withColumn("new", F.when(near, 0).otherwise(1))


@query(f"""WITH {_RETRIES}, n AS (SELECT event_id, user_id, ts, CASE WHEN before >= ts - INTERVAL 1 HOUR THEN retry_of END AS retry_of FROM o),
    g AS (SELECT *, sum((retry_of IS NULL)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS chain FROM n)
    SELECT event_id, retry_of, row_number() OVER (PARTITION BY user_id, chain ORDER BY ts, event_id) - 1 AS retry_count FROM g""")
def j06_retries(spark, sf_dir):
    """Each request with the one that it retries and the number of retries before it, however long the chain."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    chained = retries(spark, sf_dir).withColumn("chain", F.sum("new").over(w))
    return chained.select("event_id", "retry_of", (F.row_number().over(Window.partitionBy("user_id", "chain").orderBy("ts", "event_id")) - 1).cast("long").alias("retry_count"))


@query(f"""WITH {_RETRIES}, n AS (SELECT event_id, value, CASE WHEN before >= ts - INTERVAL 1 HOUR THEN retry_of END AS retry_of FROM o)
    SELECT a.event_id, a.retry_of, coalesce(b.value, -1) AS first_value, coalesce(round(a.value - b.value, 4), 0) AS change FROM n a LEFT JOIN n b ON a.retry_of = b.event_id""")
def j05_feedback_to_original(spark, sf_dir):
    """Each request joined with the one that it answers to."""
    r = stored(retries(spark, sf_dir), "retries")
    first = r.select(F.col("event_id").alias("retry_of"), F.col("value").alias("first"))
    return r.join(first, "retry_of", "left").select("event_id", "retry_of", F.coalesce("first", F.lit(-1.0)).alias("first_value"), F.coalesce(F.round(F.col("value") - F.col("first"), 4), F.lit(0.0)).alias("change"))


_KEYS = f"list_distinct(list_filter({EVAL_TOKENS}, lambda w: length(w) >= 6))"


@query(f"""WITH b AS (SELECT item_id, unnest({_KEYS}) AS w FROM benchmark), c AS (SELECT conv_id, turn, unnest({_KEYS}) AS w FROM conversations)
    SELECT item_id, conv_id, turn, count(*) AS shared FROM b JOIN c USING (w) GROUP BY ALL HAVING count(*) >= 2""")
def j09_shared_keywords(spark, sf_dir):
    """Questions and turns that share two keywords or more, by a join on keywords."""
    keys = lambda: F.explode(F.array_distinct(F.filter(text.eval_tokens(F.col("text")), lambda w: F.length(w) >= 6))).alias("w")
    b, c = table(spark, sf_dir, "benchmark").select("item_id", keys()), table(spark, sf_dir, "conversations").select("conv_id", "turn", keys())
    return b.join(c, "w").groupBy("item_id", "conv_id", "turn").agg(F.count("*").alias("shared")).filter("shared >= 2")


PLATFORMS = [("STANDARD", ["cvi", "box"]), ("PROMO", ["box"]), ("LARGE", ["cvi", "rack"])]
_PLATFORMS = "pl(family, platforms) AS (VALUES " + ", ".join(f"('{f}', {ps})" for f, ps in PLATFORMS) + ")"


@query(f"WITH {_PLATFORMS} SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(platforms, []), CASE WHEN contains(p_name, 'blue') THEN ['net'] ELSE [] END))), ',') AS platforms, family IS NOT NULL AS known FROM part LEFT JOIN pl ON family = p_type")
def j12_j17_platforms(spark, sf_dir):
    """A product's platforms by its family's record, which may be missing, and by what its name mentions."""
    dim = spark.createDataFrame(PLATFORMS, "family string, platforms array<string>")  # three rows
    none = F.array().cast("array<string>")
    both = table(spark, sf_dir, "part").join(F.broadcast(dim), F.col("family") == F.col("p_type"), "left")
    found = F.array_union(F.coalesce("platforms", none), F.when(F.col("p_name").contains("blue"), F.array(F.lit("net"))).otherwise(none))
    return both.select("p_partkey", F.array_join(F.array_sort(found), ",").alias("platforms"), F.col("family").isNotNull().alias("known"))


TERMS = [("the", "article", "det", 1), ("that", "article", "det", 2), ("wh", "question", "ask", 3), ("thou", "person", "who", 4)]


@query("WITH s(word, meaning, code, place) AS (VALUES " + ", ".join(str(t) for t in TERMS) + """), w AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark)
    SELECT item_id, count(DISTINCT word) AS words, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes, min_by(meaning, place) AS first_meaning FROM w JOIN s USING (word) GROUP BY item_id""")
def j14_term_lookups(spark, sf_dir):
    """Words of a question looked up in a table of terms: their codes, and the meaning of the term that stands first in the table."""
    dim = spark.createDataFrame(TERMS, "word string, meaning string, code string, place int")
    w = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    g = w.join(F.broadcast(dim), "word").groupBy("item_id")
    return g.agg(F.count_distinct("word").alias("words"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.min_by("meaning", "place").alias("first_meaning"))


@query("""WITH c(pattern, method, place) AS (VALUES ('BRAND#1x', 'wifi', 1), ('BRAND#x', 'standalone', 2), ('BRAND#2x', 'corded', 3)),
    h AS (SELECT p_partkey, method, place FROM part JOIN c ON regexp_matches(upper(p_brand), '^' || replace(pattern, 'x', '.') || '$'))
    SELECT p_partkey, method FROM part LEFT JOIN (SELECT p_partkey, min_by(method, place) AS method FROM h GROUP BY p_partkey) USING (p_partkey)""")
def j15_wildcard_lookup(spark, sf_dir):
    """x stands for any character; the first pattern in the table's order counts. A few patterns, so a broadcast nested loop."""
    dim = spark.createDataFrame([("BRAND#1x", "wifi", 1), ("BRAND#x", "standalone", 2), ("BRAND#2x", "corded", 3)], "pattern string, method string, place int")
    fits = F.rlike(F.upper("p_brand"), F.concat(F.lit("^"), F.replace("pattern", F.lit("x"), F.lit(".")), F.lit("$")))
    hits = table(spark, sf_dir, "part").join(F.broadcast(dim), fits, "left")
    return hits.groupBy("p_partkey").agg(F.min_by("method", "place").alias("method"))


# -- filters and funnels -----------------------------------------------------------------------------------------------------

_OTHERS = ["thou", "eau", "ment"]


@query("WITH c AS (SELECT doc_id, source, " + ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{w}', ''))) // {len(w)} AS n_{w}" for w in ["tion", *_OTHERS]) + """ FROM documents)
    SELECT doc_id FROM c WHERE source = 'src2' OR NOT (""" + " OR ".join(f"(n_{w} >= 3 AND n_{w} > n_tion + 2)" for w in _OTHERS) + ")")
def f04_strict_product_filter(spark, sf_dir):
    """Without documents in which another family than the asked one (tion) occurs three times and over two more often; one source passes."""
    low = F.lower("text")
    asked = text.substring_count(low, "tion")
    other = F.lit(False)
    for w in _OTHERS:
        n = text.substring_count(low, w)
        other = other | ((n >= 3) & (n > asked + 2))
    return table(spark, sf_dir, "documents").filter((F.col("source") == "src2") | ~other).select("doc_id")


@query(r"""WITH p AS (SELECT conv_id, turn, text AS question, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, role FROM conversations),
    f AS (SELECT CASE WHEN role <> 'user' THEN 'type' WHEN regexp_matches(question, '[\p{Han}]') THEN 'scope' WHEN regexp_matches(lower(question), ' der | die | und ') THEN 'language' WHEN answer IS NULL THEN 'no solution'
        WHEN length(answer) < 100 THEN 'short solution' WHEN regexp_matches(lower(answer), 'ship|order') THEN 'logistic' WHEN regexp_matches(question, '[?]') THEN 'request' WHEN NOT regexp_matches(lower(answer), 'tion|ment|ing') THEN 'not technical' ELSE 'kept' END AS stage FROM p)
    SELECT stage, count(*) AS n FROM f GROUP BY stage""")
def f14_candidate_funnel(spark, sf_dir):
    """Where each turn leaves the way to a question and answer pair."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    p = table(spark, sf_dir, "conversations").select("role", F.col("text").alias("question"), F.lead("text").over(w).alias("answer"))
    stage = (
        F.when(F.col("role") != "user", "type").when(F.col("question").rlike(r"[\p{IsHan}]"), "scope").when(F.lower("question").rlike(" der | die | und "), "language")
        .when(F.col("answer").isNull(), "no solution").when(F.length("answer") < 100, "short solution").when(F.lower("answer").rlike("ship|order"), "logistic")
        .when(F.col("question").rlike("[?]"), "request").when(~F.lower("answer").rlike("tion|ment|ing"), "not technical").otherwise("kept")
    )
    return p.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


# -- aggregates and windows --------------------------------------------------------------------------------------------------


@query(f"""WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter({EVAL_TOKENS}, lambda w: length(w) >= 5))) AS word FROM documents)
    SELECT word, count(DISTINCT doc_id) AS documents FROM w GROUP BY word ORDER BY documents DESC, word LIMIT 15""")
def a09_top_keywords(spark, sf_dir):
    """The fifteen keywords that most documents hold."""
    words = F.array_distinct(F.filter(text.eval_tokens(F.col("text")), lambda w: F.length(w) >= 5))
    w = table(spark, sf_dir, "documents").select(F.explode(words).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("documents")).orderBy(F.desc("documents"), "word").limit(15)


@query(f"""WITH {METRICS} SELECT count(*) AS total, count(*) FILTER (confidence >= 0.7) AS confident, count(*) FILTER (event_type = 'purchase') AS successes, count(*) FILTER (ts >= {T} - INTERVAL 7 DAY AND ts < {T}) AS week,
    count(DISTINCT ts::DATE) AS days, round(count(*) / count(DISTINCT ts::DATE)::DOUBLE, 4) AS per_day FROM metrics""")
def a14_learning_stats(spark, sf_dir):
    m, day = metrics(spark, sf_dir), F.to_date("ts")
    week = (F.col("ts") >= now() - F.expr("INTERVAL 7 DAY")) & (F.col("ts") < now())
    return m.agg(F.count("*").alias("total"), F.count_if(F.col("confidence") >= 0.7).alias("confident"), F.count_if(F.col("event_type") == "purchase").alias("successes"), F.count_if(week).alias("week"), F.count_distinct(day).alias("days"), F.round(F.count("*") / F.count_distinct(day), 4).alias("per_day"))


@query(r"""WITH w AS (SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents), c AS (SELECT word, CASE WHEN length(word) <= 2 THEN 'short' WHEN length(word) <= 6 THEN 'middle' ELSE 'long' END AS class FROM w WHERE word <> '')
    SELECT class, count(*) AS uses, count(DISTINCT word) AS words, min(word) AS first, max(word) AS last FROM c GROUP BY class""")
def a28_vocabulary_stats(spark, sf_dir):
    """Words counted before classes, so that no class gathers its uses."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    kind = F.when(F.length("word") <= 2, "short").when(F.length("word") <= 6, "middle").otherwise("long")
    return w.groupBy(kind.alias("class")).agg(F.sum("n").alias("uses"), F.count("*").alias("words"), F.min("word").alias("first"), F.max("word").alias("last"))


@query("SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ',') AS types, count(DISTINCT p_name) AS names, max(p_retailprice) AS highest, min_by(p_type, p_partkey) AS main_type FROM part GROUP BY p_brand")
def a29_merged_metadata(spark, sf_dir):
    g = table(spark, sf_dir, "part").groupBy("p_brand")
    return g.agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"), F.count_distinct("p_name").alias("names"), F.max("p_retailprice").alias("highest"), F.min_by("p_type", "p_partkey").alias("main_type"))


@query(f"""WITH {METRICS}, r AS (SELECT event_type, latency, row_number() OVER (PARTITION BY event_type ORDER BY latency, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM metrics)
    SELECT event_type, n, min(latency) FILTER (i = least(n - 1, floor(n * 0.95)::BIGINT)) AS p95, min(latency) FILTER (i = least(n - 1, floor(n * 0.99)::BIGINT)) AS p99 FROM r GROUP BY event_type, n""")
def w12_percentiles(spark, sf_dir):
    """The values at 95 and 99 hundredths of each type's ordered latencies, by distributed selection."""
    at = lambda n: [F.floor(n * p) for p in (0.95, 0.99)]
    found = quantiles.order_statistics(metrics(spark, sf_dir), "event_type", "latency", at)
    return found.select("event_type", "n", F.col("picked")[0].alias("p95"), F.col("picked")[1].alias("p99"))


@query("""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS i FROM benchmark),
    f AS (SELECT item_id, word, min(i) AS i FROM w GROUP BY item_id, word QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY min(i)) <= 8) SELECT item_id, string_agg(word, ' ' ORDER BY i) AS words FROM f GROUP BY item_id""")
def u07_ordered_distinct(spark, sf_dir):
    """The first eight different words, in order."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(F.array_distinct(words), 1, 8), " ").alias("words")).filter("words <> ''")


@query(f"WITH {METRICS} SELECT 'E' || lpad((k % 60)::VARCHAR, 3, '0') AS code, min_by(event_type, event_id) AS described, count(*) AS times FROM metrics GROUP BY 1")
def u08_entities_by_code(spark, sf_dir):
    """The first description of each code."""
    code = F.concat(F.lit("E"), F.lpad((F.col("k") % 60).cast("string"), 3, "0"))
    return metrics(spark, sf_dir).groupBy(code.alias("code")).agg(F.min_by("event_type", "event_id").alias("described"), F.count("*").alias("times"))


@query()
def u09_disjoint_spans(spark, sf_dir):
    """Regions of a document's lines (runs of tables, and steps with what follows them) of which the larger of two that overlap stays."""
    from ..operators import chunking

    t = lines(spark, sf_dir)
    tables_ = chunking.blocks(t, "table").groupBy("doc_id", "block").agg(F.min("i").alias("a"), F.max("i").alias("b")).select("doc_id", "a", "b", F.lit("table").alias("kind"))
    steps_ = chunking.steps(t).select("doc_id", F.col("i").alias("a"), F.col("last").alias("b"), F.lit("step").alias("kind"))
    return merging.disjoint_spans(tables_.unionByName(steps_), "doc_id")


# -- texts -------------------------------------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT conv_id, turn, text, text || chr(10) || '-- ' || chr(10) || 'Regards, ' || role AS signed FROM conversations)
    SELECT conv_id, turn, regexp_replace(signed, '(?s)\n-- \n.*$', '') = text AS stripped, CASE WHEN length(text) > 200 THEN substr(text, 1, 40) || chr(10) || chr(10) || substr(text, 1, 500) ELSE substr(text, 1, 40) END AS question, coalesce(nullif(text, ''), '') AS content FROM p""")
def t11_t12_t13_ticket_texts(spark, sf_dir):
    """An answer without its footer, a question of title and description, and a field that is a struct or a text or nothing."""
    c = table(spark, sf_dir, "conversations").withColumn("signed", F.concat("text", F.lit("\n-- \nRegards, "), "role")).withColumn("field", F.struct(F.col("text").alias("content")))
    stripped = F.regexp_replace("signed", r"(?s)\n-- \n.*$", "")
    title = F.substring("text", 1, 40)
    question = F.when(F.length("text") > 200, F.concat_ws("\n\n", title, F.substring("text", 1, 500))).otherwise(title)
    return c.select("conv_id", "turn", (stripped == F.col("text")).alias("stripped"), question.alias("question"), F.coalesce("field.content", F.lit("")).alias("content"))


@query("SELECT p_partkey, CASE WHEN starts_with(upper(p_type), 'PROMO') THEN 'PRO' ELSE regexp_extract(upper(p_type), '^([A-Z]{1,4})', 1) END AS family FROM part")
def t20_family_of_model(spark, sf_dir):
    model = F.upper("p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(model.startswith("PROMO"), "PRO").otherwise(F.regexp_extract(model, "^([A-Z]{1,4})", 1)).alias("family"))


@query("""WITH s AS (SELECT page_id, url || '/a.png ' || (page_id % 7) * 100 || 'w, ' || url || '/b.png ' || (page_id % 5) * 150 || 'w, ' || url || '/c.png 250w' AS srcset FROM pages),
    c AS (SELECT page_id, unnest(string_split(srcset, ', ')) AS c FROM s), w AS (SELECT page_id, regexp_extract(c, '^(\\S+)', 1) AS u, regexp_extract(c, '([0-9]+)w$', 1)::INT AS w FROM c)
    SELECT page_id, (max({'w': w, 'u': u})).u AS image FROM w GROUP BY page_id""".replace("\\\\", "\\"))
def t22_widest_source(spark, sf_dir):
    """Of an image's candidates the widest."""
    part = lambda name, width: F.concat("url", F.lit(name), width.cast("string"), F.lit("w"))
    srcset = F.concat_ws(", ", part("/a.png ", F.col("page_id") % 7 * 100), part("/b.png ", F.col("page_id") % 5 * 150), F.concat("url", F.lit("/c.png 250w")))
    sized = F.transform(F.split(srcset, ", "), lambda c: F.struct(F.regexp_extract(c, "([0-9]+)w$", 1).cast("int").alias("w"), F.regexp_extract(c, r"^(\S+)", 1).alias("u")))
    return table(spark, sf_dir, "pages").select("page_id", F.array_max(sized)["u"].alias("image"))


@query("SELECT item_id, unnest(regexp_extract_all(text, '.{0,20}thou.{0,20}')) AS context FROM benchmark")
def t25_match_contexts(spark, sf_dir):
    """Each match with up to twenty characters of its line on either side; matches within them are not shown again."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit(".{0,20}thou.{0,20}"), F.lit(0))).alias("context"))


TEMPLATES = {("en", True): "Answer in English.\nQuestion: {question}\nContext: {context}", ("en", False): "Say that you do not know: {question}", ("de", True): "Antworte auf Deutsch.\nFrage: {question}\nKontext: {context}", ("de", False): "Sage, dass du es nicht weisst: {question}"}


def _template(case):
    return F.coalesce(*[F.when(case(lang, known), F.lit(t)) for (lang, known), t in TEMPLATES.items()])


def _template_sql():
    q = lambda t: "'" + t.replace("\n", "' || chr(10) || '") + "'"
    return "CASE " + " ".join(f"WHEN lang = '{lang}' AND known = {str(known).lower()} THEN {q(t)}" for (lang, known), t in TEMPLATES.items()) + " END"


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'de' ELSE 'en' END AS lang, length(text) >= 300 AS known, substr(text, 1, 60) AS question, text AS context FROM documents)
    SELECT doc_id, md5(replace(replace({_template_sql()}, '{{question}}', question), '{{context}}', context)) AS prompt, '## ' || lang || chr(10) || '- chars: ' || length(context) || chr(10) || '- known: ' || known::VARCHAR AS formatted FROM d""")
def t26_t27_prompts_and_answers(spark, sf_dir):
    """A template by language and by what is known, filled; and a structured answer as marked-up lines."""
    lang, known = F.when(F.col("lang") == "de", "de").otherwise("en"), F.length("text") >= 300
    filled = F.replace(F.replace(_template(lambda a, b: (lang == a) & (known == b)), F.lit("{question}"), F.substring("text", 1, 60)), F.lit("{context}"), F.col("text"))
    formatted = F.concat_ws("\n", F.concat(F.lit("## "), lang), F.concat(F.lit("- chars: "), F.length("text")), F.concat(F.lit("- known: "), known.cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(filled).alias("prompt"), formatted.alias("formatted"))


# -- dates, maps, tickets ----------------------------------------------------------------------------------------------------


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S_') || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0') || '_' || event_id AS request_id FROM events")
def d05_time_ids(spark, sf_dir):
    """Ids from a time to the microsecond and a number."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format(ts, "yyyyMMdd_HHmmss_SSSSSS"), F.lit("_"), F.col("event_id")).alias("request_id"))


@query("""SELECT conv_id, 'Ticket ' || conv_id || chr(10) || 'Title: ' || substr(min_by(text, turn), 1, 40) || CASE WHEN count(*) FILTER (role = 'assistant') > 0 THEN chr(10) || 'Answers:' || chr(10) || string_agg(substr(text, 1, 5000), chr(10) ORDER BY turn) FILTER (role = 'assistant') ELSE '' END AS text FROM conversations GROUP BY conv_id""")
def d06_ticket_text(spark, sf_dir):
    """A ticket's title and, where there are some, its answers alone, each cut at 5000 characters."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    answers = F.transform(F.filter("l", lambda x: x["role"] == "assistant"), lambda x: F.substring(x["text"], 1, 5000))
    title = F.concat(F.lit("Title: "), F.substring(F.col("l")[0]["text"], 1, 40))
    return g.select("conv_id", F.concat_ws("\n", F.concat(F.lit("Ticket "), "conv_id"), title, F.when(F.size(answers) > 0, F.concat(F.lit("Answers:\n"), F.array_join(answers, "\n")))).alias("text"))


@query(f"WITH {METRICS} SELECT event_id, event_type AS kind, CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END AS priority, 'en' AS lang, coalesce(try_cast(CASE WHEN k % 3 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE), 0.5) AS score FROM metrics")
def d07_d09_maps_and_floats(spark, sf_dir):
    """Defaults overlaid by a row's own map (its keys win), and a number from text or else a default."""
    own = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("priority"), F.lit("high"))).otherwise(F.create_map(F.lit("note"), F.lit("-")))
    own = F.map_concat(own, F.create_map(F.lit("kind"), F.col("event_type")))
    value = lambda key, default: F.coalesce(F.col("own")[key], F.lit(default))
    given = F.when(F.col("k") % 3 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return metrics(spark, sf_dir).select("event_id", own.alias("own"), given.alias("given")).select("event_id", value("kind", "none").alias("kind"), value("priority", "low").alias("priority"), value("lang", "en").alias("lang"), F.coalesce(F.col("given").try_cast("double"), F.lit(0.5)).alias("score"))


@query(f"""WITH {METRICS}, h AS (SELECT user_id, ts, md5(k::VARCHAR) AS h, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM metrics WHERE event_type = 'signup')
    SELECT user_id, string_agg(substr(h, 1, 8), ',' ORDER BY n) AS kept, count(*) AS n, max(ts)::VARCHAR[:19] AS last_change FROM h WHERE n <= 5 GROUP BY user_id""".replace("max(ts)::VARCHAR[:19]", "strftime(max(ts), '%Y-%m-%d %H:%M:%S')"))
def d11_last_five(spark, sf_dir):
    """The last five digests of each user, newest first, and the time of the last change."""
    m = metrics(spark, sf_dir).filter("event_type = 'signup'").select("user_id", "ts", "event_id", F.substring(F.md5(F.col("k").cast("string")), 1, 8).alias("h"))
    last = retrieval.top(m, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    g = last.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "h"))).alias("l"), F.count("*").alias("n"), F.max("ts").alias("t"))
    return g.select("user_id", F.array_join("l.h", ",").alias("kept"), "n", F.date_format(F.col("t").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("last_change"))


# -- state and learning ------------------------------------------------------------------------------------------------------


@query(f"WITH a AS (SELECT user_id, count(*) AS attempts, max(ts) AS last_attempt FROM events WHERE event_type = 'error' GROUP BY user_id) SELECT user_id, attempts FROM a WHERE user_id % 11 <> 0 AND last_attempt >= {T} - INTERVAL 5 DAY")
def z06_unblock_and_cleanup(spark, sf_dir):
    """Records of attempts without those of the unblocked (a table of users) and without old ones."""
    a = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("attempts"), F.max("ts").alias("last_attempt"))
    unblocked = table(spark, sf_dir, "events").select("user_id").filter("user_id % 11 = 0").distinct()
    return a.join(unblocked, "user_id", "left_anti").filter(F.col("last_attempt") >= now() - F.expr("INTERVAL 5 DAY")).select("user_id", "attempts")


_LAST = "last_value(CASE WHEN role = 'user' THEN nullif(regexp_extract(text, '([A-Z][a-z]+)', 1), '') END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query(f"SELECT conv_id, turn, md5(CASE WHEN topic IS NULL THEN text ELSE regexp_replace(text, '(^| )(it|this) ', '\\1' || topic || ' ', 'g') END) AS resolved, topic FROM (SELECT *, {_LAST} AS topic FROM conversations)")
def z08_references(spark, sf_dir):
    """it and this become what the user named last before the turn."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    name = F.regexp_extract("text", "([A-Z][a-z]+)", 1)
    topic = F.last(F.when((F.col("role") == "user") & (name != ""), name), ignorenulls=True).over(w)
    c = table(spark, sf_dir, "conversations").withColumn("topic", topic)
    resolved = F.when(F.col("topic").isNull(), F.col("text")).otherwise(F.regexp_replace(F.col("text"), F.lit("(^| )(it|this) "), F.concat(F.lit("$1"), "topic", F.lit(" "))))
    return c.select("conv_id", "turn", F.md5(resolved).alias("resolved"), "topic")


@query("SELECT DISTINCT md5(text) AS digest FROM documents")
def z14_first_wins(spark, sf_dir):
    """Each text once; on a stream the first that arrives."""
    return first_of_each(table(spark, sf_dir, "documents").select(F.md5("text").alias("digest")), "digest")


_MAPPED = """rated AS (SELECT f.event_id, f.source, f.positive, m.k % 7 AS topic FROM feedback f JOIN metrics m USING (event_id))"""


@query(f"""WITH {FEEDBACK}, {_MAPPED} SELECT topic, count(*) FILTER (positive) AS reinforced, count(*) FILTER (NOT positive) AS demoted, round(least(1.0, greatest(0.0, 0.5 + 0.05 * count(*) FILTER (positive) - 0.1 * count(*) FILTER (NOT positive))), 6)::DOUBLE AS confidence,
    array_to_string(list_sort(list(DISTINCT source) FILTER (positive)), ',') AS sources FROM rated GROUP BY topic""")
def l04_reinforced_mappings(spark, sf_dir):
    """Mappings by key: each rating reinforces or demotes the one of its topic."""
    r = _rated(spark, sf_dir)
    good, bad = F.count_if("positive"), F.count_if(~F.col("positive"))
    return r.groupBy("topic").agg(good.alias("reinforced"), bad.alias("demoted"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 0.05 * good - 0.1 * bad)), 6).alias("confidence"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("positive"), F.col("source")))), ",").alias("sources"))


def _rated(spark, sf_dir):
    return feedback(spark, sf_dir).join(metrics(spark, sf_dir).select("event_id", (F.col("k") % 7).alias("topic")), "event_id")


@query(f"""WITH {FEEDBACK}, {_MAPPED}, c AS (SELECT topic, source, count(*) FILTER (positive) AS p, count(*) AS n FROM rated GROUP BY ALL),
    b AS (SELECT topic, source, row_number() OVER (PARTITION BY topic ORDER BY p DESC, source) AS up, row_number() OVER (PARTITION BY topic ORDER BY n - p DESC, source) AS down, p, n FROM c)
    SELECT topic, string_agg(source, ',' ORDER BY up) FILTER (up <= 5) AS boost, string_agg(source, ',' ORDER BY down) FILTER (down <= 10 AND 2 * p < n) AS exclude, max(p / n::DOUBLE) >= 0.8 AS has_solution FROM b GROUP BY topic""")
def l06_learned_context(spark, sf_dir):
    """Of each topic five sources to boost, ten at most to leave out, and whether some source solves four fifths."""
    c = _rated(spark, sf_dir).groupBy("topic", "source").agg(F.count_if("positive").alias("p"), F.count("*").alias("n"))
    up = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("p"), "source"))
    down = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.col("n") - F.col("p")), "source"))
    listed = lambda place, cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct(place, "source")))), lambda x: x["source"]), ",")
    g = c.withColumn("up", up).withColumn("down", down).groupBy("topic")
    found = g.agg(listed("up", F.col("up") <= 5).alias("boost"), listed("down", (F.col("down") <= 10) & (2 * F.col("p") < F.col("n"))).alias("exclude"), (F.max(F.col("p") / F.col("n")) >= 0.8).alias("has_solution"))
    return found.withColumn("exclude", F.when(F.col("exclude") != "", F.col("exclude")))


@query(f"""WITH {FEEDBACK}, {_MAPPED}, w AS (SELECT topic, round(greatest(0.5, least(3.0, 1.0 + 0.1 * count(*) FILTER (positive) - 0.05 * count(*) FILTER (NOT positive))), 6)::DOUBLE AS weight FROM rated GROUP BY topic),
    p AS (SELECT topic, min(source) FILTER (positive) AS good, min(source) FILTER (NOT positive) AS bad FROM rated GROUP BY topic) SELECT topic, weight, good, bad FROM w JOIN p USING (topic)""")
def l10_learning_loop(spark, sf_dir):
    """From one log of ratings: a weight for each topic, and a pair of sources to learn the difference from."""
    good = F.col("positive")
    return _rated(spark, sf_dir).groupBy("topic").agg(F.round(F.greatest(F.lit(0.5), F.least(F.lit(3.0), 1.0 + 0.1 * F.count_if(good) - 0.05 * F.count_if(~good))), 6).alias("weight"), F.min(F.when(good, F.col("source"))).alias("good"), F.min(F.when(~good, F.col("source"))).alias("bad"))


@query(f"WITH {FEEDBACK} SELECT (SELECT count(*) FROM feedback) AS removed, 0::BIGINT AS remaining")
def l11_reset(spark, sf_dir):
    """A stored log of ratings emptied, and what it held."""
    from ..sources.tables import shared_path

    path, log = shared_path(spark, "ratings"), feedback(spark, sf_dir)
    log.write.parquet(path)
    held = stored(spark.read.schema(log.schema).parquet(path).agg(F.count("*").alias("removed")), "removed")
    log.filter("false").write.mode("overwrite").parquet(path)
    return held.crossJoin(spark.read.schema(log.schema).parquet(path).agg(F.count("*").alias("remaining")))  # one row each


# -- checks of answers -------------------------------------------------------------------------------------------------------


@query(rf"""WITH s AS (SELECT p_partkey, {_SPEC} AS spec, 'Torque ' || (p_size + 10) || ' NM, speed ' || (p_size * 10 + (p_partkey % 3 = 0)::INT) || ' rpm, weight ' || p_size || '.5 kg' AS answer FROM part),
    a AS (SELECT p_partkey, unnest(regexp_extract_all(lower(answer), '[0-9]+(?:[.][0-9]+)? ?(?:nm|rpm|kg)')) AS m, spec FROM s),
    n AS (SELECT p_partkey, regexp_extract(m, '^([0-9.]+)', 1)::DOUBLE AS value, regexp_extract(m, '([a-z]+)$', 1) AS unit, regexp_extract_all(lower(spec), '[0-9]+(?:[.][0-9]+)? ?(?:nm|rpm|kg)') AS known FROM a)
    SELECT p_partkey, value, unit FROM n WHERE len(list_filter(known, lambda k: regexp_extract(k, '([a-z]+)$', 1) = unit AND abs(regexp_extract(k, '^([0-9.]+)', 1)::DOUBLE - value) <= 0.01)) = 0""")
def r11_ungrounded_numbers(spark, sf_dir):
    """Numbers with units in an answer that its context does not hold, to a hundredth and whatever the unit's case."""
    answer = F.concat(F.lit("Torque "), F.col("p_size") + 10, F.lit(" NM, speed "), F.col("p_size") * 10 + (F.col("p_partkey") % 3 == 0).cast("int"), F.lit(" rpm, weight "), "p_size", F.lit(".5 kg"))
    return spec_texts(spark, sf_dir).select("p_partkey", rules.ungrounded(answer, F.col("spec"), ["nm", "rpm", "kg"]).alias("l")).select("p_partkey", F.explode("l").alias("x")).select("p_partkey", "x.value", "x.unit")


@query("""WITH c AS (SELECT conv_id, turn, text, [length(text) < 30, regexp_matches(text, 'thou|Thou') AND NOT regexp_matches(text, 'tion'), regexp_matches(lower(text), 'eau|wireless')] AS f FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN f[1] THEN 'short' END, CASE WHEN f[2] THEN 'product' END, CASE WHEN f[3] THEN 'forbidden' END], lambda x: x IS NOT NULL), ',') AS issues FROM c""")
def r12_answer_checks(spark, sf_dir):
    """Too short, another product than the asked one, or phrases that the product forbids."""
    t = F.col("text")
    issues = [F.when(F.length(t) < 30, "short"), F.when(t.rlike("thou|Thou") & ~t.rlike("tion"), "product"), F.when(F.lower(t).rlike("eau|wireless"), "forbidden")]
    return table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.array_join(F.array_compact(F.array(*issues)), ",").alias("issues"))
