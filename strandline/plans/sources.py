"""Sources and sinks: files written from the tables and read back, upserts, ingestion and listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import merging, text_index
from ..sources import tables
from .chunks import h10_adaptive_ingest, tickets
from .registry import ORACLES, query
from .searching import BM25_SQL
from .views import BM25_TOKENS, table


@query(f"""WITH t AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
    {BM25_SQL.replace("FROM documents", "FROM t")} SELECT query_id, doc_id, score, rank FROM bm25 WHERE rank <= 5""")
def s06_weighted_text_search(spark, sf_dir):
    """Benchmark questions against all turns of each conversation, as one text."""
    said = F.sort_array(F.collect_list(F.struct("turn", "text")))
    t = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(said.alias("l")).select("doc_id", F.array_join("l.text", " ").alias("text"))
    return text_index.search(text_index.build(t, name="turns"), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 5)


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), '[.](html?|php)([?#]|$)') THEN 'html' WHEN regexp_matches(lower(url), '[?]') THEN 'query' WHEN regexp_matches(lower(url), '#') THEN 'anchor' ELSE 'plain' END AS reader
    FROM pages WHERE length(trim(html)) >= 50""")
def s10_format_dispatch(spark, sf_dir):
    """The reader by what the address ends in; pages of less than fifty characters are left out."""
    kind = F.when(F.lower("url").rlike("[.](html?|php)([?#]|$)"), "html").when(F.lower("url").rlike("[?]"), "query").when(F.lower("url").rlike("#"), "anchor").otherwise("plain")
    return table(spark, sf_dir, "pages").filter(F.length(F.trim("html")) >= 50).select("page_id", kind.alias("reader"))


@query("SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY source")
def s11_directory_scan(spark, sf_dir):
    """Documents as JSON files in a folder per source, scanned again from the folder above."""
    path = tables.shared_path(spark, "scan")
    tables.export_json(table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("folder"), "source"), path, "folder")
    return tables.scan(spark, path, "doc_id long, text string, source string").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("SELECT p_partkey, 'Name: ' || p_name || chr(10) || 'Brand: ' || p_brand || chr(10) || 'Size: ' || p_size AS spec FROM part")
def s12_spec_source(spark, sf_dir):
    """Products as JSON, read back as readable lines."""
    path = tables.shared_path(spark, "specs")
    tables.export_json(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), path)
    found = tables.scan(spark, path, "p_partkey long, p_name string, p_brand string, p_size int")
    return found.select("p_partkey", F.concat_ws("\n", F.concat(F.lit("Name: "), "p_name"), F.concat(F.lit("Brand: "), "p_brand"), F.concat(F.lit("Size: "), "p_size")).alias("spec"))


_TICKETS = "tickets AS (SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"


@query(f"WITH {_TICKETS} SELECT conv_id, turns, md5(text) AS digest, NULL::VARCHAR AS assignee FROM tickets WHERE turns >= 2")
def s13_ticket_source(spark, sf_dir):
    """Tickets from JSON files, with a field of no use nulled."""
    path = tables.shared_path(spark, "tickets")
    tables.export_json(tickets(spark, sf_dir).withColumn("assignee", F.lit("someone")), path)
    found = tables.scan(spark, path, "conv_id long, turns long, text string, assignee string").filter("turns >= 2")
    return found.select("conv_id", "turns", F.md5("text").alias("digest"), F.lit(None).cast("string").alias("assignee"))


@query("""WITH o AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0), n AS (SELECT c_custkey, c_name || '+' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)
    SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal, o.c_mktsegment FROM o FULL JOIN n ON o.c_custkey = n.c_custkey""")
def s15_bulk_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    new = c.filter("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit("+")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return merging.upsert(c.filter("c_custkey % 5 <> 0").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), new, "c_custkey")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderkey % 4 <> 0), n AS (SELECT o_orderkey, 'X' AS o_orderstatus FROM orders WHERE o_orderkey % 6 = 0)
    SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(n.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(o.o_orderdate, TIMESTAMP '2024-01-31 00:00:00') AS created,
        CASE WHEN n.o_orderkey IS NULL THEN o.o_orderdate ELSE TIMESTAMP '2024-01-31 00:00:00' END AS updated FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey""")
def s18_ticket_upsert(spark, sf_dir):
    """Upsert with the times of creation and of the last change."""
    orders = table(spark, sf_dir, "orders")
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    old = orders.filter("o_orderkey % 4 <> 0").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("created"), F.col("o_orderdate").cast("timestamp").alias("updated"))
    new = orders.filter("o_orderkey % 6 = 0").select("o_orderkey", F.lit("X").alias("o_orderstatus"), now.alias("updated"))
    return merging.upsert(old, new, "o_orderkey").withColumn("created", F.coalesce("created", now))


@query("SELECT (SELECT count(*) FROM part) AS inserted, (SELECT count(*) FROM part) AS counted, 0::BIGINT AS after_clearing")
def s19_insert_count_clear(spark, sf_dir):
    """Products inserted in two goes, counted, and the collection overwritten by nothing."""
    p, path = table(spark, sf_dir, "part"), tables.shared_path(spark, "collection")
    p.filter("p_partkey % 2 = 0").write.mode("append").parquet(path)
    p.filter("p_partkey % 2 = 1").write.mode("append").parquet(path)
    held = tables.stored(spark.read.schema(p.schema).parquet(path).agg(F.count("*").alias("inserted")), "count")
    p.filter("false").write.mode("overwrite").parquet(path)
    left = spark.read.schema(p.schema).parquet(path).agg(F.count("*").alias("after_clearing"))
    return held.withColumn("counted", F.col("inserted")).crossJoin(left)  # one row each


@query("""WITH kept AS (SELECT doc_id, source, text FROM documents WHERE source <> 'src3'), fresh AS (SELECT doc_id, source, regexp_replace(trim(text), '[ ]+', ' ', 'g') AS text FROM documents WHERE source = 'src3' AND length(text) >= 50)
    SELECT doc_id, source, md5(text) AS digest, 1 AS version FROM kept UNION ALL SELECT doc_id, source, md5(text), 2 FROM fresh""")
def s21_targeted_reingest(spark, sf_dir):
    """One source is read again from its file, cleaned and filtered; the others stay as they are."""
    d, path = table(spark, sf_dir, "documents"), tables.shared_path(spark, "source")
    tables.export_json(d.filter("source = 'src3'").select("doc_id", "source", "text"), path)
    fresh = tables.scan(spark, path, "doc_id long, source string, text string").filter(F.length("text") >= 50)
    fresh = fresh.select("doc_id", "source", F.md5(F.regexp_replace(F.trim("text"), "[ ]+", " ")).alias("digest"), F.lit(2).alias("version"))
    return d.filter("source <> 'src3'").select("doc_id", "source", F.md5("text").alias("digest"), F.lit(1).alias("version")).unionByName(fresh)


@query(f"WITH ingested AS ({ORACLES['h10_adaptive_ingest']}) SELECT strategy, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM ingested GROUP BY strategy")
def s24_batch_ingest(spark, sf_dir):
    """Documents to chunks to a stored collection, and what it then holds of each strategy."""
    held = tables.stored(h10_adaptive_ingest(spark, sf_dir), "collection")
    return held.groupBy("strategy").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"))


_ENRICHED = r"""doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS words, greatest(1, length(text) // 4) AS tokens, regexp_matches(text, '[0-9]{3,}') AS has_numbers, regexp_matches(lower(text), 'licen[sc]e') AS has_licence,
    CASE WHEN length(text) >= 2000 THEN 0.9 WHEN length(text) >= 200 THEN 0.6 ELSE 0.3 END::DOUBLE AS importance"""


@query(f"SELECT {_ENRICHED} FROM documents")
def s25_payload_enrichment(spark, sf_dir):
    """Metadata of every document anew, from its text."""
    t, n = F.col("text"), F.length("text")
    importance = F.when(n >= 2000, 0.9).when(n >= 200, 0.6).otherwise(0.3)
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(t).alias("words"), text.estimated_tokens(t).alias("tokens"), t.rlike("[0-9]{3,}").alias("has_numbers"), F.lower(t).rlike("licen[sc]e").alias("has_licence"), importance.alias("importance"))


@query("SELECT p_partkey, p_name, p_brand AS maker_brand, p_type AS maker_type, p_size || ', ' || (p_size + 1) AS sizes FROM part")
def s26_export(spark, sf_dir):
    """Products with a struct and an array, as CSV and back."""
    p, path = table(spark, sf_dir, "part"), tables.shared_path(spark, "export")
    tables.export_csv(p.select("p_partkey", "p_name", F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).alias("maker"), F.array("p_size", F.col("p_size") + 1).alias("sizes")), path)
    return tables.read_csv(spark, path, "p_partkey long, p_name string, maker_brand string, maker_type string, sizes string")


@query(f"WITH p AS ({ORACLES['e05_question_answer_pairs']}) SELECT conv_id, turn, md5(replace(replace(substr(question, 1, 300), chr(13), ''), chr(10), ' ')) AS question, md5(replace(replace(substr(answer, 1, 300), chr(13), ''), chr(10), ' ')) AS answer, 'user, assistant' AS roles FROM p")
def s27_question_answer_file(spark, sf_dir):
    """Question and answer pairs cut at 300 characters, as CSV and back."""
    from .searching import e05_question_answer_pairs

    path = tables.shared_path(spark, "pairs")
    line = lambda c: F.replace(F.replace(F.substring(c, 1, 300), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(" "))
    pairs = e05_question_answer_pairs(spark, sf_dir).select("conv_id", "turn", line("question").alias("question"), line("answer").alias("answer"), F.array(F.lit("user"), F.lit("assistant")).alias("roles"))
    tables.export_csv(pairs, path)
    return tables.read_csv(spark, path, "conv_id long, turn long, question string, answer string, roles string").withColumn("question", F.md5("question")).withColumn("answer", F.md5("answer"))


@query("""WITH a AS (SELECT source, count(*) AS n, sum(length(text)) AS chars FROM documents GROUP BY source), b AS (SELECT source, count(*) AS n, sum(length(text)) AS chars FROM (SELECT DISTINCT ON (md5(text)) * FROM documents ORDER BY md5(text), doc_id) GROUP BY source)
    SELECT source, a.n AS left_rows, coalesce(b.n, 0) AS right_rows, abs(a.n - coalesce(b.n, 0)) <= greatest(10, 0.05 * a.n) AS alike FROM a LEFT JOIN b USING (source)""")
def s29_store_parity(spark, sf_dir):
    """A store against another that was filled without copies, source by source."""
    d = table(spark, sf_dir, "documents")
    first = d.withColumn("digest", F.md5("text")).groupBy("digest").agg(F.min_by("source", "doc_id").alias("source"))
    other = tables.stored(first, "other-store").groupBy("source").agg(F.count("*").alias("r"))
    both = d.groupBy("source").agg(F.count("*").alias("left_rows")).join(other, "source", "left")
    both = both.select("source", "left_rows", F.coalesce("r", F.lit(0)).alias("right_rows"))
    return both.withColumn("alike", F.abs(F.col("left_rows") - F.col("right_rows")) <= F.greatest(F.lit(10.0), 0.05 * F.col("left_rows")))


@query("SELECT source, true AS listed, true AS filled FROM documents GROUP BY source")
def s30_document_listing(spark, sf_dir):
    """Files of a folder per source by name and size, newest first in each; their contents are not read."""
    path = tables.shared_path(spark, "listing")
    tables.export_json(table(spark, sf_dir, "documents").select("doc_id", "source"), path, "source")
    files = tables.listing(spark, path, "*.json").withColumn("source", F.regexp_extract("path", "source=([^/]*)/", 1))
    newest = files.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("modificationTime"), "path")))
    return newest.groupBy("source").agg((F.max("n") >= 1).alias("listed"), (F.sum("length") > 0).alias("filled"))
