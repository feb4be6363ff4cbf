"""Grades of answers, checks of golden queries, and their summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import grading, scores, text
from ..operators import retrieval
from .registry import ORACLES, query
from .searching import e01_e04_keyword_overlap, e05_question_answer_pairs
from .views import METRICS, chunks, metrics, table

_PAIRS = f"p AS ({ORACLES['e05_question_answer_pairs']})"
_OVERLAP = f"o AS ({ORACLES['e01_e04_keyword_overlap']})"


@query()
def e02_rouge_l(spark, sf_dir):
    """Each assistant turn against the question before it."""
    pairs = e05_question_answer_pairs(spark, sf_dir)
    score = grading.rouge_l(text.eval_tokens(F.col("question")), text.eval_tokens(F.col("answer")))
    scored = pairs.select("conv_id", "turn", score.alias("rouge_l"))
    return scored.withColumn("grade", F.when(F.col("rouge_l") >= 0.10, "good").when(F.col("rouge_l") >= 0.05, "partial").otherwise("fail"))


_CODES = "list_distinct(regexp_extract_all(upper({}), '[EW][0-9]{{3,4}}'))"


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, len(list_filter(['page', 'http', 'thou'], lambda w: contains(lower(answer), w))) > 0 AS cited,
    len({_CODES.format('answer')}) > 0 AND NOT list_has_any({_CODES.format('answer')}, {_CODES.format('question')}) AS invented FROM p""")
def e03_answer_flags(spark, sf_dir):
    pairs = e05_question_answer_pairs(spark, sf_dir)
    return pairs.select("conv_id", "turn", grading.cites_source(F.col("answer"), ["page", "http", "thou"]).alias("cited"), grading.invented_codes(F.col("answer"), F.col("question")).alias("invented"))


@query(f"""WITH {_PAIRS} SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN length(answer) < 100 THEN 'short' END, CASE WHEN NOT contains(lower(answer), 'the') THEN 'lacks word' END,
    CASE WHEN contains(lower(answer), 'password') THEN 'forbidden word' END, CASE WHEN length(answer) > 2000 THEN 'long' END], lambda x: x IS NOT NULL), ',') AS issues FROM p""")
def e07_e08_answer_issues(spark, sf_dir):
    """What is wrong with each answer, as a list in fixed order."""
    low, n = F.lower("answer"), F.length("answer")
    issues = F.array_compact(F.array(F.when(n < 100, "short"), F.when(~low.contains("the"), "lacks word"), F.when(low.contains("password"), "forbidden word"), F.when(n > 2000, "long")))
    return e05_question_answer_pairs(spark, sf_dir).select("conv_id", "turn", F.array_join(issues, ",").alias("issues"))


@query(f"""WITH {_OVERLAP} SELECT query_id % 4 AS model, count(*) AS n, count(*) FILTER (grade = 'good') AS good, count(*) FILTER (grade = 'partial') AS partial, count(*) FILTER (grade = 'fail') AS fail,
    round(avg(mean), 6) AS mean FROM o GROUP BY ROLLUP (query_id % 4)""")
def a20_a21_grade_summary(spark, sf_dir):
    """Grades for each configuration and for all together."""
    o = e01_e04_keyword_overlap(spark, sf_dir).withColumn("model", F.col("query_id") % 4)
    of = [F.count_if(F.col("grade") == g).alias(g) for g in ("good", "partial", "fail")]
    return o.rollup("model").agg(F.count("*").alias("n"), *of, F.round(F.avg("mean"), 6).alias("mean"))


@query(f"WITH {_OVERLAP} SELECT query_id, mean FROM o ORDER BY mean, query_id LIMIT 20")
def k07_hardest(spark, sf_dir):
    return e01_e04_keyword_overlap(spark, sf_dir).select("query_id", "mean").orderBy("mean", "query_id").limit(20)


@query("SELECT item_id FROM benchmark ORDER BY item_id LIMIT 10 OFFSET 5")
def k08_slice(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id").orderBy("item_id").offset(5).limit(10)


@query(f"""WITH {METRICS}, s AS (SELECT count(*) AS n, avg(latency) AS mean, count(*) FILTER (cache_hit) * 100.0 / count(*) AS hits, count(*) FILTER (event_type = 'error') * 100.0 / count(*) AS errors FROM metrics)
    SELECT n, array_to_string(list_filter([CASE WHEN mean > 1000 THEN 'slow' END, CASE WHEN hits < 40 THEN 'cold cache' END, CASE WHEN errors > 10 THEN 'errors' END], lambda x: x IS NOT NULL), ',') AS issues,
    CASE WHEN errors > 25 THEN 'critical' WHEN mean > 1000 OR hits < 40 OR errors > 10 THEN 'degraded' ELSE 'healthy' END AS status FROM s""")
def a13_health(spark, sf_dir):
    of = lambda c: F.count_if(c) * 100.0 / F.count("*")
    s = metrics(spark, sf_dir).agg(F.count("*").alias("n"), F.avg("latency").alias("mean"), of(F.col("cache_hit")).alias("hits"), of(F.col("event_type") == "error").alias("errors"))
    slow, cold, failing = F.col("mean") > 1000, F.col("hits") < 40, F.col("errors") > 10
    issues = F.array_compact(F.array(F.when(slow, "slow"), F.when(cold, "cold cache"), F.when(failing, "errors")))
    return s.select("n", F.array_join(issues, ",").alias("issues"), F.when(F.col("errors") > 25, "critical").when(slow | cold | failing, "degraded").otherwise("healthy").alias("status"))


@query(f"""WITH {METRICS} SELECT event_type, round(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (cache_hit) * 100.0 / count(*) END, 1) AS hit_rate,
    round(avg(latency), 4) AS mean_latency, count(*) FILTER (confidence >= 0.7) AS confident FROM metrics GROUP BY event_type""")
def a07_a10_a11_rates(spark, sf_dir):
    g = metrics(spark, sf_dir).groupBy("event_type")
    return g.agg(scores.rate(F.count_if("cache_hit"), F.count("*")).alias("hit_rate"), F.round(F.avg("latency"), 4).alias("mean_latency"), F.count_if(F.col("confidence") >= 0.7).alias("confident"))


@query(f"""WITH {METRICS} SELECT user_id, event_id, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS micros FROM metrics WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def a27_stage_times(spark, sf_dir):
    """Time from each mark of a user to the next."""
    w, at = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.col("ts").cast("timestamp")
    return metrics(spark, sf_dir).select("user_id", "event_id", (F.unix_micros(F.lead(at).over(w)) - F.unix_micros(at)).alias("micros"))


_RETRIEVERS = """SELECT 'similarity' AS config, source, doc_id, (doc_id * 37 % 101) / 100.0::DOUBLE AS score FROM documents
    UNION ALL SELECT 'importance', source, doc_id, (doc_id % 10) / 10.0::DOUBLE FROM documents"""


@query(f"""WITH r AS ({_RETRIEVERS}), t AS (SELECT *, row_number() OVER (PARTITION BY config, source ORDER BY score DESC, doc_id) AS rank FROM r)
    SELECT config, count(*) AS hits, round(avg(quality), 6) AS good, count(DISTINCT source) AS sources FROM t JOIN labels USING (doc_id) WHERE rank <= 10 GROUP BY config""")
def e06_configurations(spark, sf_dir):
    """Rankings side by side: how many of their ten best per source are labelled good."""
    c = chunks(spark, sf_dir)
    each = [c.select(F.lit(name).alias("config"), "source", "doc_id", F.col(name).alias("score")) for name in ("similarity", "importance")]
    best = retrieval.top(each[0].unionByName(each[1]), ["config", "source"], [F.desc("score"), F.col("doc_id")], 10)
    judged = best.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return judged.groupBy("config").agg(F.count("*").alias("hits"), F.round(F.avg("quality"), 6).alias("good"), F.count_distinct("source").alias("sources"))
