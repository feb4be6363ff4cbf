"""The registered query of each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, fill_in_middle, line_dedup, mixing, packing, piece_codec, quality, simhash, suffix_dedup, toxicity, warc, whitening
from .shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids stay out of the result: their checksum stands for them."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ids=False)


def op2_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_labelled(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_piece_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), texts=False)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op6_line_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_co_trained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(quality.features(table(spark, sf_dir, "documents")), "features")  # read by each round and by the scoring
    model = quality.fit_features(found, table(spark, sf_dir, "labels"))
    return quality.score_features(found, model).withColumn("held_out", toxicity.held_out(F.col("doc_id")))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), texts=False)


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sum_of_squares_packing, op2_subword_toxicity, op3_exact_dedup, op4_piece_encode_decode, op5_simhash_near_dedup, op6_line_run_dedup, op7_co_trained_quality, op8_warc_round_trip, op9_projected_neighbours, op10_suffix_array_dedup, op11_source_mixing, op12_fill_in_middle, op13_whitening)}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm)""",
    "op6_line_run_dedup": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, lines, len(lines) AS n, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
        w AS (SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after, i + 1 < n AS pair FROM l),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) AS k FROM w WHERE pair),
        p AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS k FROM l WHERE length(line) >= 300),
        c AS (SELECT doc_id, unnest([i, i + 1]) AS i FROM r WHERE k > 1 UNION SELECT doc_id, i FROM p WHERE k > 1),
        m AS (SELECT l.doc_id, l.i, line, c.i IS NOT NULL AS gone FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.i = c.i),
        g AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS head FROM m)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (head) AS n_runs,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM g GROUP BY doc_id""",
    "op8_warc_round_trip": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h
            FROM pages),
        d AS (
            SELECT page_id, n, max(page_id) OVER (PARTITION BY html) AS keep,
                   list_transform(range(8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::BIGINT) AS fives
            FROM p)
        SELECT page_id, n AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i:
                   substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((fives[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
               CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
        FROM d""",
    "op12_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
                   sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
            FROM documents),
        c AS (
            SELECT doc_id, text, lines, len(lines) AS n, list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS draws,
                   text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain
            FROM d),
        p AS (
            SELECT doc_id, text, n, CASE WHEN plain THEN 'plain' WHEN draws[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
                   array_to_string(lines[:least(draws[1] % (n + 1), draws[2] % (n + 1))], '') AS prefix,
                   array_to_string(lines[least(draws[1] % (n + 1), draws[2] % (n + 1)) + 1:greatest(draws[1] % (n + 1), draws[2] % (n + 1))], '') AS middle,
                   array_to_string(lines[greatest(draws[1] % (n + 1), draws[2] % (n + 1)) + 1:], '') AS suffix
            FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
}
