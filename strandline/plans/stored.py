"""Changes of stored tables, version by version: smart upserts, tickets, a source read again, a purge that is carried out and verified."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merging
from ..sources.tables import shared_path
from ..sources.versions import Versions
from .registry import query
from .selecting import _UPSERT, _upsert_sides
from .views import table

NOW = "2024-01-31 00:00:00"


def _all_versions(t: Versions) -> DataFrame:
    """The rows of every version, read again from its files."""
    return reduce(DataFrame.unionByName, [t.read(v).withColumn("version", F.lit(v)) for v in range(1, t.latest() + 1)])


@query(_UPSERT + " SELECT 1 AS version, o.* FROM o UNION ALL SELECT 2, c_custkey, c_name, c_mktsegment, c_acctbal FROM m")
def s16_stored_upsert(spark, sf_dir):
    """Customers stored, then merged with newer ones in the parts these fall into; both versions."""
    old, new = _upsert_sides(spark, sf_dir)
    t = Versions(spark, shared_path(spark, "customers"), old.schema, "c_custkey")
    t.insert(old)
    t.change(new, lambda o, n: merging.smart_upsert(o, n, "c_custkey", forced=["c_acctbal"]).drop("action"))
    return _all_versions(t)


@query(f"""WITH one AS (SELECT o_orderkey, o_orderstatus, o_orderdate::TIMESTAMP AS created, o_orderdate::TIMESTAMP AS updated FROM orders WHERE o_orderkey % 4 <> 0),
    two AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.s, o.o_orderstatus) AS o_orderstatus, coalesce(o.created, TIMESTAMP '{NOW}') AS created, CASE WHEN n.s IS NULL THEN o.updated ELSE TIMESTAMP '{NOW}' END AS updated
        FROM one o FULL JOIN (SELECT o_orderkey, 'X' AS s FROM orders WHERE o_orderkey % 6 = 0) n ON o.o_orderkey = n.o_orderkey)
    SELECT 2 AS version, o_orderstatus, count(*) AS n, count(*) FILTER (created = updated) AS never_changed, min(created) AS first_created, max(updated) AS last_updated FROM two GROUP BY ALL
    UNION ALL SELECT 1, o_orderstatus, count(*), count(*), min(created), max(updated) FROM one GROUP BY ALL""")
def s18_stored_tickets(spark, sf_dir):
    """Tickets stored and upserted with the times of creation and of the last change; what either version holds of each status."""
    orders, now = table(spark, sf_dir, "orders"), F.lit(NOW).cast("timestamp")
    at = F.col("o_orderdate").cast("timestamp")
    old = orders.filter("o_orderkey % 4 <> 0").select("o_orderkey", "o_orderstatus", at.alias("created"), at.alias("updated"))
    new = orders.filter("o_orderkey % 6 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), now.alias("updated"))
    t = Versions(spark, shared_path(spark, "orders"), old.schema, "o_orderkey")
    t.insert(old)
    t.change(new, lambda o, n: merging.upsert(o, n, "o_orderkey").withColumn("created", F.coalesce("created", now)))
    never = F.count_if(F.col("created") == F.col("updated")).alias("never_changed")
    return _all_versions(t).groupBy("version", "o_orderstatus").agg(F.count("*").alias("n"), never, F.min("created").alias("first_created"), F.max("updated").alias("last_updated"))


def _stored_documents(spark, sf_dir) -> Versions:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    t = Versions(spark, shared_path(spark, "documents"), d.schema, "doc_id", by="source")
    t.insert(d)
    return t


@query("""WITH d AS (SELECT doc_id, source, text FROM documents), fresh AS (SELECT doc_id, source, regexp_replace(trim(text), '[ ]+', ' ', 'g') AS text FROM d WHERE source = 'src3' AND length(text) >= 50)
    SELECT 1 AS version, doc_id, source, md5(text) AS digest FROM d UNION ALL SELECT 2, doc_id, source, md5(text) FROM d WHERE source IS DISTINCT FROM 'src3' UNION ALL SELECT 2, doc_id, source, md5(text) FROM fresh""")
def s21_stored_reingest(spark, sf_dir):
    """Documents stored by source; one source cleaned, filtered and put in the place of its rows. Both versions, by digest."""
    t = _stored_documents(spark, sf_dir)
    fresh = table(spark, sf_dir, "documents").filter((F.col("source") == "src3") & (F.length("text") >= 50))
    t.replace(["src3"], fresh.select("doc_id", "source", F.regexp_replace(F.trim("text"), "[ ]+", " ").alias("text")))
    return _all_versions(t).select("version", "doc_id", "source", F.md5("text").alias("digest"))


@query("""WITH d AS (SELECT source, text, length(text) < 50 AS short FROM documents)
    SELECT 1 AS version, source, count(*) AS n, sum(length(text))::BIGINT AS chars, (SELECT count(*) FILTER (short) FROM d) AS dry_run FROM d GROUP BY source
    UNION ALL SELECT 2, source, count(*), sum(length(text))::BIGINT, 0 FROM d WHERE short IS NOT TRUE GROUP BY source""")
def s22_stored_purge(spark, sf_dir):
    """Short documents counted in a dry run, then deleted; what both versions hold, and what another dry run finds in each."""
    t = _stored_documents(spark, sf_dir)
    short = F.length("text") < 50
    found = t.purge(short, dry_run=True)[1]
    t.purge(short)
    left = t.purge(short, dry_run=True)[1]
    n = _all_versions(t).groupBy("version", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
    return n.withColumn("dry_run", F.when(F.col("version") == 1, F.lit(found)).otherwise(F.lit(left)).cast("long"))
