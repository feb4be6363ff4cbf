"""Hybrid search over the variants of a question: each is searched by itself, and ranks run over their lists one after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, scores
from ..operators import retrieval, text_index
from .hybrid import DENSE, EXPANDED, WEIGHTS, _dense, expanded
from .registry import query
from .searching import BM25_SQL
from .views import CHUNKS, QUESTION_CLASSES, chunks, table

#: Hits of a variant, and documents that one bulletin may have among a question's hits.
HITS, OF_BULLETIN = 20, 3
_FUSED = f"""{EXPANDED}, {WEIGHTS}, asked AS (SELECT item_id * 8 + generate_subscripts(variants, 1) AS item_id, unnest(variants) AS text FROM expanded),
    {BM25_SQL.replace('FROM benchmark', 'FROM asked')}, {DENSE}, {CHUNKS},
    lexical_hits AS (SELECT query_id // 8 AS query_id, doc_id, row_number() OVER (PARTITION BY query_id // 8 ORDER BY query_id % 8, rank) AS place FROM bm25 WHERE rank <= {HITS}),
    parts AS (SELECT query_id, doc_id, lexical / (60 + place) AS part, 1 AS variants FROM lexical_hits JOIN weights ON item_id = query_id
        UNION ALL SELECT query_id, doc_id, (1 - lexical) / (60 + rank), 0 FROM dense_top JOIN weights ON item_id = query_id),
    fused AS (SELECT query_id, doc_id, round(sum(part), 8) AS rrf, sum(variants)::BIGINT AS variants FROM parts GROUP BY ALL)"""
_FOUND = f"""{_FUSED}, boosted AS (SELECT f.*, source, document_type, md5(text) AS digest, round(rrf * (CASE WHEN importance >= 0.8 THEN 1.3 ELSE 1.0 END) * (CASE WHEN is_warning THEN 1.2 ELSE 1.0 END) * (CASE WHEN is_procedure THEN 1.15 ELSE 1.0 END), 8) AS boosted FROM fused f JOIN chunks USING (doc_id)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, document_type = 'bulletin' ORDER BY boosted DESC, doc_id) AS of_bulletin FROM boosted),
    once AS (SELECT * FROM placed WHERE document_type <> 'bulletin' OR of_bulletin <= {OF_BULLETIN} QUALIFY row_number() OVER (PARTITION BY query_id, digest ORDER BY boosted DESC, doc_id) = 1)"""


def fused_variants(spark, sf_dir):
    """query_id, doc_id, rrf, variants: reciprocal ranks over the variants' word hits, in order, and the question's vector hits; variants
    tells how many of them found the document. Only the question itself has a vector."""
    asked = expanded(spark, sf_dir).select("item_id", F.posexplode("variants").alias("i", "text")).select((F.col("item_id") * 8 + F.col("i") + 1).alias("query_id"), "text")
    hits = text_index.search(text_index.build(table(spark, sf_dir, "documents")), asked, HITS)
    hits = hits.select(F.floor(F.col("query_id") / 8).cast("long").alias("query_id"), (F.col("query_id") % 8).alias("variant"), "doc_id", "rank")
    w = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), rules.retrieval_weights(F.col("text"), QUESTION_CLASSES)["lexical"].alias("lexical"))
    words = retrieval.concatenated(hits, "query_id", "variant").join(w, "query_id").select("query_id", "doc_id", (F.col("lexical") / (60 + F.col("place"))).alias("part"), F.lit(1).alias("one"))
    vectors = _dense(spark, sf_dir).join(w, "query_id").select("query_id", "doc_id", ((1 - F.col("lexical")) / (60 + F.col("rank"))).alias("part"), F.lit(0).alias("one"))
    return words.unionByName(vectors).groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 8).alias("rrf"), F.sum("one").alias("variants"))


@query(f"WITH {_FUSED} SELECT query_id, doc_id, rrf, variants FROM fused")
def r05_variant_rrf(spark, sf_dir):
    """Weighted reciprocal ranks of all questions over the lists of their variants."""
    return fused_variants(spark, sf_dir)


@query(f"WITH {_FOUND} SELECT query_id, doc_id, boosted, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, doc_id) AS rank FROM once QUALIFY rank <= 5")
def r06_variant_search(spark, sf_dir):
    """Every question by its variants: fused, boosted, three documents of a bulletin's source at most, without copies, the best five."""
    c = chunks(spark, sf_dir).select("doc_id", "source", "document_type", "importance", "is_warning", "is_procedure", F.md5("text").alias("digest"))
    boost = scores.metadata_boost(F.col("importance"), F.col("is_warning"), F.col("is_procedure"), F.lit(0))
    best = [F.desc("boosted"), F.col("doc_id")]
    hits = fused_variants(spark, sf_dir).join(c, "doc_id").withColumn("boosted", F.round(F.col("rrf") * boost, 8))
    hits = retrieval.limited(hits, ["query_id", "source"], best, OF_BULLETIN, F.col("document_type") == "bulletin")
    once = retrieval.first_per_key(hits, ["query_id", "digest"], best)
    return retrieval.top(once.select("query_id", "doc_id", "boosted"), ["query_id"], best, 5)
