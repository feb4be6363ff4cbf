"""Aggregates, windows, sorts and learning over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import quantiles, retrieval
from .registry import query
from .views import AS_OF, CHUNKS, FEEDBACK, METRICS, chunks, feedback, metrics, table



def now():
    return F.lit(AS_OF).cast("timestamp")


T = f"TIMESTAMP '{AS_OF}'"


@query("SELECT l_partkey AS part, count(*) AS n, min(l_orderkey) AS first_order FROM lineitem GROUP BY l_partkey ORDER BY n DESC, part LIMIT 10")
def a04_top_products(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first_order"))
    return g.orderBy(F.desc("n"), "part").limit(10)


@query(f"SELECT count(DISTINCT user_id) AS active_users FROM events WHERE ts >= {T} - INTERVAL 7 DAY AND ts < {T}")
def a05_active_users(spark, sf_dir):
    recent = table(spark, sf_dir, "events").filter((F.col("ts") >= now() - F.expr("INTERVAL 7 DAY")) & (F.col("ts") < now()))
    return recent.agg(F.count_distinct("user_id").alias("active_users"))


@query(f"""WITH {METRICS} SELECT count(*) AS total, count(*) FILTER (event_type = 'purchase') AS positive, count(*) FILTER (event_type = 'error') AS negative,
    count(*) FILTER (confidence >= 0.7) AS confident, count(*) FILTER (ts >= {T} - INTERVAL 1 DAY) AS today, count(*) FILTER (ts >= {T} - INTERVAL 7 DAY) AS week,
    round(count(*) FILTER (event_type = 'purchase') * 100.0 / count(*), 1) AS positive_rate FROM metrics""")
def a06_conditional_counts(spark, sf_dir):
    m, kind = metrics(spark, sf_dir), F.col("event_type")
    counts = m.agg(F.count("*").alias("total"), F.count_if(kind == "purchase").alias("positive"), F.count_if(kind == "error").alias("negative"), F.count_if(F.col("confidence") >= 0.7).alias("confident"), F.count_if(F.col("ts") >= now() - F.expr("INTERVAL 1 DAY")).alias("today"), F.count_if(F.col("ts") >= now() - F.expr("INTERVAL 7 DAY")).alias("week"))
    return counts.withColumn("positive_rate", scores.rate(F.col("positive"), F.col("total")))


@query(f"""WITH days AS (SELECT unnest(generate_series({T} - INTERVAL 7 DAY, {T} - INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS d)
    SELECT strftime(d, '%Y-%m-%d') AS day, strftime(d, '%a') AS weekday, count(event_id) AS n FROM days LEFT JOIN events ON ts::DATE = d GROUP BY d""")
def a08_daily_trend(spark, sf_dir):
    """Counts of seven days, those without events too."""
    days = spark.sql(f"SELECT explode(sequence(date '{AS_OF[:10]}' - 7, date '{AS_OF[:10]}' - 1)) AS d")
    counts = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").alias("n"))
    return days.join(counts, "d", "left").select(F.date_format("d", "yyyy-MM-dd").alias("day"), F.date_format("d", "EEE").alias("weekday"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {METRICS} SELECT event_type, count(*) AS n, count(*) FILTER (cache_hit) AS hits, round(avg(latency), 4) AS mean_latency,
    round(quantile_cont(latency, 0.95), 4) AS p95, round(quantile_cont(latency, 0.99), 4) AS p99 FROM metrics GROUP BY event_type""")
def a12_latency_percentiles(spark, sf_dir):
    """Counts and means of each type, and quantiles by distributed selection."""
    m = metrics(spark, sf_dir)
    p = lambda i: F.round(F.col("quantiles")[i], 4)
    found = quantiles.quantiles(m, "event_type", "latency", [0.95, 0.99]).select(F.col("event_type").alias("kind"), p(0).alias("p95"), p(1).alias("p99"))
    counts = m.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("cache_hit").alias("hits"), F.round(F.avg("latency"), 4).alias("mean_latency"))
    return counts.join(found, F.col("event_type").eqNullSafe(F.col("kind")), "left").drop("kind")


@query("""SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total, grouping(user_id) AS all_users, grouping(event_type) AS all_types
    FROM events GROUP BY CUBE (user_id, event_type)""")
def a22_grouping_sets(spark, sf_dir):
    return table(spark, sf_dir, "events").cube("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.grouping("user_id").cast("long").alias("all_users"), F.grouping("event_type").cast("long").alias("all_types"))


@query("SELECT event_type, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS share FROM events GROUP BY event_type")
def a16_category_share(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 1))  # a handful of rows


@query("""SELECT count(DISTINCT conv_id) AS sessions, round(count(*) / count(DISTINCT conv_id)::DOUBLE, 6) AS mean_turns, max(turn) AS longest FROM conversations""")
def a23_session_stats(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("turn").alias("last"))
    return c.agg(F.count("*").alias("sessions"), F.round(F.sum("turns") / F.count("*"), 6).alias("mean_turns"), F.max("last").alias("longest"))


@query("SELECT source, list_sort(list(DISTINCT lang)) AS langs, count(*) AS n FROM documents GROUP BY source")
def a25_set_accumulation(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.count("*").alias("n"))


@query(f"WITH {CHUNKS} SELECT source, doc_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, doc_id) AS rank FROM chunks) WHERE rank <= 3")
def w02_top_n_per_group(spark, sf_dir):
    return retrieval.top(chunks(spark, sf_dir), ["source"], [F.desc("similarity"), F.col("doc_id")], 3).select("source", "doc_id", "similarity", "rank")


@query(f"""WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY source, document_type ORDER BY similarity DESC, doc_id) = 1 AND document_type IN ('bulletin', 'manual') AS pick FROM chunks),
    t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pick DESC, similarity DESC, doc_id) AS n FROM r)
    SELECT source, doc_id, document_type, similarity, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, doc_id) AS rank FROM t WHERE n <= 5""")
def w04_diversity_quota(spark, sf_dir):
    picked = retrieval.quota_pick(chunks(spark, sf_dir), ["source"], "document_type", ["bulletin", "manual"], [F.desc("similarity"), F.col("doc_id")], 5)
    return picked.select("source", "doc_id", "document_type", "similarity", "rank")


@query(f"""WITH {CHUNKS}, s AS (SELECT source, doc_id, greatest(1, length(text) // 4) AS tokens,
        sum(greatest(1, length(text) // 4) + 20) OVER (PARTITION BY source ORDER BY similarity DESC, doc_id ROWS UNBOUNDED PRECEDING) AS total, similarity FROM chunks),
    o AS (SELECT *, sum((total > 2000)::INT) OVER (PARTITION BY source ORDER BY similarity DESC, doc_id ROWS UNBOUNDED PRECEDING) AS nth FROM s)
    SELECT source, doc_id, tokens, nth = 1 AS truncated, CASE WHEN nth = 1 THEN 2000 - (total - tokens - 20) - 20 ELSE tokens END::BIGINT AS taken_tokens FROM o
    WHERE nth = 0 OR (nth = 1 AND total > 2000 AND 2000 - (total - tokens - 20) - 20 > 100)""")
def w05_token_budget(spark, sf_dir):
    from ..functions.text import estimated_tokens

    rows = chunks(spark, sf_dir).select("source", "doc_id", "similarity", estimated_tokens(F.col("text")).alias("tokens"))
    return retrieval.token_budget(rows, ["source"], [F.desc("similarity"), F.col("doc_id")], 2000).select("source", "doc_id", "tokens", "truncated", "taken_tokens")


@query("SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS recent FROM events")
def w09_sliding_request_count(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")).rangeBetween(-3600, 0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.count("*").over(w).alias("recent"))


@query("SELECT conv_id, turn, text FROM conversations WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def w10_last_user_message(spark, sf_dir):
    users = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return users.groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("m")).select("conv_id", "m.turn", "m.text")


@query(f"WITH {METRICS} SELECT event_id, latency FROM metrics WHERE latency > 5000 ORDER BY latency DESC, event_id LIMIT 20")
def k04_slow_queries(spark, sf_dir):
    return metrics(spark, sf_dir).filter("latency > 5000").orderBy(F.desc("latency"), "event_id").limit(20).select("event_id", "latency")


_WILSON = "(p / n::DOUBLE + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((p / n::DOUBLE * (1 - p / n::DOUBLE) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n)"


@query(f"""WITH {FEEDBACK}, s AS (SELECT source, count(*) AS n, sum(positive::INT) AS p FROM feedback GROUP BY source)
    SELECT source, n AS ratings, p::BIGINT AS positive, round({_WILSON}, 6) AS wilson,
           round(1.0 * (1 - least(1.0, ln(n + 1) / ln(20))) + 2 * ({_WILSON}) * least(1.0, ln(n + 1) / ln(20)), 6) AS score FROM s""")
def l01_source_scores(spark, sf_dir):
    s = feedback(spark, sf_dir).groupBy("source").agg(F.count("*").alias("ratings"), F.sum(F.col("positive").cast("long")).alias("positive"))
    n, p = F.col("ratings"), F.col("positive")
    return s.withColumn("wilson", F.round(scores.wilson_lower(p, n), 6)).withColumn("score", F.round(scores.learned_score(F.lit(1.0), p, n), 6))


@query("""SELECT user_id, count(*) AS attempts, CASE WHEN count(*) >= 15 THEN 1440 WHEN count(*) >= 10 THEN 60 WHEN count(*) >= 5 THEN 15 ELSE 0 END AS minutes
    FROM events WHERE event_type = 'error' GROUP BY user_id""")
def c15_ban_levels(spark, sf_dir):
    attempts = table(spark, sf_dir, "events").filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("attempts"))
    return attempts.withColumn("minutes", scores.ban_minutes(F.col("attempts")))


@query(f"SELECT event_id, ts, {T} - ts > INTERVAL 1 DAY AS expired FROM events")
def d04_expiry(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "ts", (now() - F.col("ts") > F.expr("INTERVAL '1' DAY")).alias("expired"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, event_type || ':' || (props->>'$.k') AS tag FROM events")
def d08_json_props(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.cast("long").alias("k"), F.concat("event_type", F.lit(":"), k).alias("tag"))


@query("SELECT doc_id, substr(md5(text), 1, 12) AS short_id, substr(sha256(text), 1, 16) AS content_id FROM documents")
def d10_digest_prefixes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5("text"), 1, 12).alias("short_id"), F.substring(F.sha2("text", 256), 1, 16).alias("content_id"))


@query("""
    WITH g AS (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh
               FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, session::BIGINT AS session, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY ALL""")
def z07_sessions(spark, sf_dir):
    """A pause of more than 30 minutes (strictly) ends a session."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag(F.col("ts").cast("timestamp")).over(w))
    rows = table(spark, sf_dir, "events").withColumn("fresh", F.when(gap.isNull() | (gap > 1_800_000_000), 1).otherwise(0))
    numbered = rows.withColumn("session", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
