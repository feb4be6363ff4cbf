"""Documents from raw to packed: each stage reads what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import exact_dedup, packing, simhash, suffix_dedup, toxicity
from strandline.llm.shared import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows whose texts the toxicity model, fitted on the labels, predicts toxic; each row is judged by itself."""
    model = toxicity.fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model).select(COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.exact_dedup(docs).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest id."""
    return simhash.simhash_dedup(docs).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; what is left of a cut character goes too.

    Documents of which nothing remains are copies of others in pieces, and go.
    """
    found = suffix_dedup.suffix_dedup(docs, carry=["lang", "source", "n_chars"]).filter("n_removed < n_bytes OR n_removed = 0")
    cut = F.col("n_removed") > 0
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    text = F.when(cut, F.replace(text, F.lit("\ufffd"), F.lit(""))).otherwise(text)
    return found.withColumn("text", text).withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", clean_documents), ("exact dedup", exact_copies), ("simhash near-dedup", near_copies), ("suffix-array dedup", repeated_passages), ("packing", packed)]

#: No SQL expresses a trained model; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
