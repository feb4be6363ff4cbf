"""Learning from ratings, recommendations and training pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import learning, retrieval
from ..streaming.keyed_state import late_feedback
from .registry import query
from .views import AS_OF, FEEDBACK, METRICS, feedback, metrics, table

_KEYWORDS = "['t' || (k % 5), 'u' || (k % 3), 'v' || (k % 4)]"
RATED = METRICS + f""", rated AS (
    SELECT event_id, ts, user_id, 'src' || (k % 20) AS source, event_type = 'purchase' AS positive, {_KEYWORDS} AS keywords
    FROM metrics WHERE event_type IN ('purchase', 'error'))"""


def rated(spark, sf_dir):
    """Ratings with the keywords of what was asked."""
    m = metrics(spark, sf_dir).filter(F.col("event_type").isin("purchase", "error"))
    keywords = F.array(*[F.concat(F.lit(c), F.col("k") % n) for c, n in (("t", 5), ("u", 3), ("v", 4))])
    return m.select("event_id", "ts", "user_id", F.concat(F.lit("src"), F.col("k") % 20).alias("source"), (F.col("event_type") == "purchase").alias("positive"), keywords.alias("keywords"))


_MAPPINGS = f"""{RATED}, mappings AS (
    SELECT list_sort(keywords) AS keywords, substr(md5(array_to_string(list_sort(keywords), '_')), 1, 12) AS mapping,
           count(*) FILTER (positive) AS successes, count(*) FILTER (NOT positive) AS failures,
           round(count(*) FILTER (positive) / count(*), 6) AS rate,
           coalesce(list_sort(list(DISTINCT source) FILTER (positive)), []) AS preferred, coalesce(list_sort(list(DISTINCT source) FILTER (NOT positive)), []) AS avoided
    FROM rated GROUP BY 1, 2)"""
_ADVICE = f"""{_MAPPINGS}, asked AS (SELECT * FROM (SELECT user_id, keywords AS kw, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM rated) WHERE n = 1),
    hits AS (SELECT user_id, m.*, row_number() OVER (PARTITION BY user_id ORDER BY rate DESC, mapping) AS rank FROM asked, mappings m WHERE list_has_any(kw, keywords) AND rate >= 0.6),
    words AS (SELECT user_id, list_sort(list_distinct(flatten(list(preferred)))) AS p, list_sort(list_distinct(flatten(list(avoided)))) AS a FROM hits WHERE rank <= 3 GROUP BY user_id),
    advice AS (SELECT user_id, p[1:5] AS recommended, a[1:5] AS avoided, least(1.0, len(p[1:5]) / 5.0)::DOUBLE AS confidence FROM words)"""


def _advice(spark, sf_dir):
    r = rated(spark, sf_dir)
    asked = retrieval.first_per_key(r, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "keywords")
    return asked, learning.recommendations(asked, learning.keyword_mappings(r), "user_id")


@query(f"WITH {_MAPPINGS} SELECT mapping, successes, failures, rate, array_to_string(preferred, ',') AS preferred, array_to_string(avoided, ',') AS avoided FROM mappings")
def l02_keyword_mappings(spark, sf_dir):
    m = learning.keyword_mappings(rated(spark, sf_dir))
    return m.select("mapping", "successes", "failures", "rate", F.array_join("preferred", ",").alias("preferred"), F.array_join("avoided", ",").alias("avoided"))


@query(f"WITH {_ADVICE} SELECT user_id, array_to_string(recommended, ',') AS recommended, array_to_string(avoided, ',') AS avoided, confidence FROM advice")
def l03_recommendations(spark, sf_dir):
    """For each user's newest rating: sources of the three best mappings that share a keyword."""
    found = _advice(spark, sf_dir)[1]
    return found.select("user_id", F.array_join("recommended", ",").alias("recommended"), F.array_join("avoided", ",").alias("avoided"), "confidence")


@query(f"""WITH {RATED} SELECT source, count(*) FILTER (positive) AS relevant, count(*) FILTER (NOT positive) AS irrelevant, count(*) AS total,
    array_to_string(list_sort(list_distinct(flatten(list(keywords)))), ',') AS keywords FROM rated GROUP BY source""")
def l05_source_relevance(spark, sf_dir):
    """Counters and keywords of each source; keywords are made distinct before they are gathered."""
    r = rated(spark, sf_dir).select("source", "positive", F.explode("keywords").alias("word"))
    words = r.select("source", "word").distinct().groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("word")), ",").alias("keywords"))
    counts = rated(spark, sf_dir).groupBy("source").agg(F.count_if("positive").alias("relevant"), F.count_if(~F.col("positive")).alias("irrelevant"), F.count("*").alias("total"))
    return counts.join(words, "source")


_BEST = f"""{_ADVICE}, best AS (SELECT source, row_number() OVER (ORDER BY count(*) FILTER (positive) * 1.0 / count(*) DESC, source) AS place FROM rated GROUP BY source),
    last AS (SELECT user_id, source AS original FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM rated) WHERE n = 1),
    pool AS (SELECT user_id, unnest(recommended) AS source, 0 AS tier, 0 AS place FROM advice UNION ALL SELECT user_id, source, 1, place FROM last, best WHERE place <= 15),
    once AS (SELECT user_id, source, min(tier * 1000 + place) AS spot FROM pool GROUP BY ALL)"""


@query(f"""WITH {_BEST} SELECT user_id, source, rank FROM (SELECT o.user_id, o.source, row_number() OVER (PARTITION BY o.user_id ORDER BY spot, o.source) AS rank
    FROM once o JOIN last l ON o.user_id = l.user_id LEFT JOIN advice d ON d.user_id = o.user_id
    WHERE o.source <> l.original AND NOT list_contains(coalesce(d.avoided, []), o.source)) WHERE rank <= 5""")
def l07_alternatives(spark, sf_dir):
    """Five sources for a retry: recommended ones, then the fifteen best of all; neither the one tried nor avoided ones."""
    r = rated(spark, sf_dir)
    _, advice = _advice(spark, sf_dir)
    last = retrieval.first_per_key(r, ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", F.col("source").alias("original"))
    share = r.groupBy("source").agg((F.count_if("positive") / F.count("*")).alias("share")).orderBy(F.desc("share"), "source").limit(15)
    best = share.agg(F.sort_array(F.collect_list(F.struct((-F.col("share")).alias("s"), "source"))).alias("b")).select(F.posexplode("b").alias("place", "b")).select(F.col("b.source").alias("source"), (F.col("place") + 1001).alias("at"))
    pool = advice.select("user_id", F.explode("recommended").alias("source"), F.lit(0).alias("at")).unionByName(last.select("user_id").crossJoin(F.broadcast(best)))  # fifteen rows
    once = pool.groupBy("user_id", "source").agg(F.min("at").alias("at")).join(last, "user_id").join(advice.select("user_id", "avoided"), "user_id", "left")
    fit = once.filter((F.col("source") != F.col("original")) & ~F.coalesce(F.array_contains("avoided", F.col("source")), F.lit(False)))
    return retrieval.top(fit, ["user_id"], [F.col("at"), F.col("source")], 5).select("user_id", "source", "rank")


@query("SELECT count(*) AS samples, count(*) FILTER (doc_id % 3 <> 0) AS unused, count(*) FILTER (doc_id % 3 <> 0) >= 100 AS ready FROM labels")
def l08_retrain_gate(spark, sf_dir):
    unused = F.count_if(F.col("doc_id") % 3 != 0)
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("samples"), unused.alias("unused"), (unused >= 100).alias("ready"))


@query("""WITH l AS (SELECT source, doc_id, quality FROM documents JOIN labels USING (doc_id)), n AS (SELECT source, min(doc_id) AS negative FROM l WHERE quality = 0 GROUP BY source)
    SELECT source AS anchor, doc_id AS positive, negative FROM l JOIN n USING (source) WHERE quality = 1""")
def l09_contrastive_pairs(spark, sf_dir):
    """Each good document of a source with the source's first bad one."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    first = rows.filter("quality = 0").groupBy("source").agg(F.min("doc_id").alias("negative"))
    return rows.filter("quality = 1").join(first, "source").select(F.col("source").alias("anchor"), F.col("doc_id").alias("positive"), "negative")


@query(f"""WITH {RATED} SELECT term, round(list_reduce(list(CASE WHEN positive THEN 0.1::DOUBLE ELSE -0.05::DOUBLE END ORDER BY ts, event_id), lambda w, a: greatest(0.5, least(3.0, w + a)), 1.0::DOUBLE), 6) AS weight
    FROM (SELECT *, unnest(keywords) AS term FROM rated) GROUP BY term""")
def m20_term_weights(spark, sf_dir):
    r = rated(spark, sf_dir).withColumn("term", F.explode("keywords"))
    return learning.term_weights(r, "term", ["ts", "event_id"], F.date_trunc("hour", "ts"))


@query(f"""WITH {FEEDBACK} SELECT source, round(least(1.0, count(*) FILTER (positive) / count(*) + least(count(*) / 10.0, 1.0) * 0.2), 6)::DOUBLE AS confidence FROM feedback GROUP BY source""")
def m16_mapping_confidence(spark, sf_dir):
    g = feedback(spark, sf_dir).groupBy("source").agg(F.count_if("positive").alias("p"), F.count("*").alias("n"))
    return g.select("source", F.round(scores.mapping_confidence(F.col("p"), F.col("n")), 6).alias("confidence"))


@query(f"""WITH {FEEDBACK}, s AS (SELECT source, count(*) FILTER (positive) * 100.0 / count(*) AS share FROM feedback GROUP BY source)
    SELECT source, round(share, 2) AS score FROM s ORDER BY round(share, 2) DESC, source LIMIT 10""")
def k05_top_sources(spark, sf_dir):
    g = feedback(spark, sf_dir).groupBy("source").agg(F.round(F.count_if("positive") * 100.0 / F.count("*"), 2).alias("score"))
    return g.orderBy(F.desc("score"), "source").limit(10)


@query(f"""WITH {METRICS} SELECT user_id, event_id, rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM metrics) WHERE rank BETWEEN 3 AND 7""")
def w06_recent_history(spark, sf_dir):
    """Each user's newest requests, two skipped and five shown."""
    newest = retrieval.top(metrics(spark, sf_dir), ["user_id"], [F.desc("ts"), F.desc("event_id")], 7)
    return newest.filter("rank > 2").select("user_id", "event_id", "rank")


@query(f"""WITH {METRICS}, p AS (SELECT event_id, user_id, ts, k FROM metrics WHERE event_type = 'view'), f AS (SELECT event_id AS f_id, user_id, ts AS f_ts, event_type = 'purchase' AS positive FROM metrics WHERE event_type IN ('purchase', 'error'))
    SELECT f_id, event_id AS request, positive FROM (SELECT *, row_number() OVER (PARTITION BY f_id ORDER BY ts DESC, event_id DESC) AS n FROM f JOIN p USING (user_id) WHERE ts <= f_ts) WHERE n = 1""")
def z11_late_feedback(spark, sf_dir):
    """Each rating with its user's newest request before it: both in one order, the last request carried forward.

    The running maximum replaces a join of all ratings with all requests of a user.
    """
    m = metrics(spark, sf_dir).filter(F.col("event_type").isin("view", "purchase", "error"))
    asked = F.when(F.col("event_type") == "view", F.struct("ts", "event_id"))
    order = Window.partitionBy("user_id").orderBy(F.col("ts"), (F.col("event_type") != "view").cast("int"), "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = m.withColumn("r", F.max(asked).over(order)).filter("event_type <> 'view' AND r IS NOT NULL")
    return seen.select(F.col("event_id").alias("f_id"), F.col("r.event_id").alias("request"), (F.col("event_type") == "purchase").alias("positive"))


@query(f"""WITH {METRICS}, p AS (SELECT event_id, user_id, ts FROM metrics WHERE event_type = 'view'), f AS (SELECT event_id AS f_id, user_id, ts AS f_ts, event_type = 'purchase' AS positive FROM metrics WHERE event_type IN ('purchase', 'error'))
    SELECT f_id, event_id AS request, positive FROM (SELECT *, row_number() OVER (PARTITION BY f_id ORDER BY ts DESC, event_id DESC) AS n FROM f JOIN p USING (user_id) WHERE ts <= f_ts AND ts >= f_ts - INTERVAL 6 HOUR) WHERE n = 1""")
def z11_feedback_in_time(spark, sf_dir):
    """Each rating with its user's newest request of the six hours before; on streams the same join, with watermarks."""
    m = metrics(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    asked = m.filter("event_type = 'view'").select("user_id", "event_id", "ts")
    rated_ = m.filter("event_type IN ('purchase', 'error')").select("user_id", F.col("event_id").alias("f_id"), F.col("ts").alias("f_ts"), (F.col("event_type") == "purchase").alias("positive"))
    return late_feedback(asked, rated_, "user_id", "6 hours")


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 20 DAY")
def z13_expired_log(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("ts") >= F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 20 DAY")).select("event_id")


@query("""SELECT user_id, CASE WHEN ('0x' || substr(md5(user_id::VARCHAR), 1, 6))::BIGINT % 100 < 50 THEN 'v2' ELSE 'v1' END AS route, count(*) AS requests FROM events GROUP BY 1, 2""")
def z15_routing(spark, sf_dir):
    """Half of the users on the new version, by a digest of their id, so that they stay there."""
    bucket = F.conv(F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 6), 16, 10).cast("long") % 100
    counts = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("requests"))
    return counts.select("user_id", F.when(bucket < 50, "v2").otherwise("v1").alias("route"), "requests")
