"""Exact duplicates by an extendible-hash index that is kept as tables in the shared folder.

The index key of a text is its 64-bit hash. Buckets are prefixes of the key. A directory doubles as long as a bucket holds more
distinct keys than its capacity: that bucket is split by the next bit, so that crowded prefixes get long addresses and others
short ones. Each key is placed in its bucket as the directory grows. Only texts whose key occurs again can have a copy: these go to
the owner tasks of their buckets, which chain different texts that share a key and compare whole byte strings. All of it is
DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keyed_join, written

#: Distinct keys that a bucket holds before it is split.
BUCKET_KEYS = 4096
#: Parts into which the copies of a text are dealt, aggregated in each task, on their way to its owner.
SALTS = 16

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null as the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def placed(keys: DataFrame, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """keys (a table with a column key, each key once) with bucket and local_depth: the bucket's address is the key's leading
    local_depth bits.

    The directory begins at the depth at which buckets would be full if the keys were spread evenly, and doubles until no bucket
    is overfull.
    """
    depth = max(0, (keys.count() // bucket_keys).bit_length() - 1)
    left, done = keys, []
    while True:
        bucket = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
        addressed = left.withColumn("bucket", bucket)
        sizes = written(addressed.groupBy("bucket").agg(F.count("*").alias("held")), "directory")
        full = F.col("held") > bucket_keys if depth < 64 else F.lit(False)  # different keys part within 64 bits
        dealt = written(keyed_join(addressed, sizes, ["bucket"], "inner", "held").withColumn("overfull", full).drop("held"), "bucket-keys")
        done.append(dealt.filter("NOT overfull").drop("overfull").withColumn("local_depth", F.lit(depth)))
        left = dealt.filter("overfull").drop("overfull", "bucket")
        if not left.head(1):
            return reduce(DataFrame.unionByName, done)
        depth += 1


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, local_depth, chain.

    Of equal texts the row with the largest id stays. bucket, local_depth and chain tell where the index keeps
    a text that has copies (chain counts from 0 among texts that share a key); they are null for the others.

    A null text is the empty text, a very long one is read whole. A null id never wins against another; rows of a group that has
    only null ids, and rows that repeat the largest id, all stay. An empty table gives an empty table. Other columns of docs,
    whatever their names, are not read.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    entries = written(text.select("doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("text_sha256")), "entries")
    keys = written(entries.groupBy("key").agg(F.count("*").alias("n")), "keys")
    again = written(placed(keys, bucket_keys).filter("n > 1"), "repeated-keys")

    # Only texts of repeated keys go on; a task sends the copies of a text to an owner as one row for each salt.
    candidates = keyed_join(text.withColumn("key", F.xxhash64("norm")), again, ["key"], "inner")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    sent = candidates.groupBy("bucket", "local_depth", "key", "norm", salt).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = sent.repartition("bucket").groupBy("bucket", "local_depth", "key", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("norm")) - 1
    owned = groups.withColumn("chain", chain).select("key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size", "bucket", "local_depth", "chain")
    index = written(owned, "index")
    found = keyed_join(entries, index, ["key", "text_sha256"], "left", "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256", "bucket", "local_depth", "chain",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Rows go by id and text, so that others of a null or repeated id stay. Whether a row stays depends on these two alone.
    """
    groups = exact_groups(docs, id_col, text_col)
    gone = groups.filter("NOT kept").groupBy(F.col("doc_id").alias("_gone"), F.col("text_sha256").alias("_gone_sha256")).agg(F.count("*").alias("_rows"))
    gone = written(gone.drop("_rows"), "dropped-rows")
    same = docs[id_col].eqNullSafe(gone["_gone"]) & (F.sha2(normalised(docs[text_col]), 256) == gone["_gone_sha256"])
    return docs.join(gone.hint("merge"), same, "left_anti")
