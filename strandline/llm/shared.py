"""Tables in the cluster's shared folder, and joins that hold whatever share of the rows one key has."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A key is hot if it holds more than one in HOT_KEYS of the rows, and HOT_ROWS at least; so there are fewer than HOT_KEYS of them.
HOT_KEYS, HOT_ROWS = 10_000, 100
#: Words of 64 bits in which sieved_join() marks keys: a table of two million bytes, whatever the number of keys.
SIEVE_WORDS = 1 << 17


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master may go without that setting; it then gets a new temporary folder, which is kept
    for the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and outlives executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that written() made."""
    spark = df.sparkSession
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def released(spark: SparkSession) -> None:
    """Ask for a collection of garbage: the shuffle files of datasets that nothing refers to go then, so that the disk holds those of
    a long job's last steps only."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, n: str = "n") -> DataFrame:
    """Join left with a table that has each key once and, as column n, how many rows of left hold it.

    how: inner, left, left_semi or left_anti. Fewer than HOT_KEYS keys can hold more than one in HOT_KEYS of the rows counted:
    only these hot ones are broadcast, so their rows stay where they are. All others meet in a sort-merge join, at every size.
    right should be a table, for it is read thrice; keys are never null.
    """
    total = right.agg(F.sum(n)).first()[0] or 0
    is_hot = (F.col(n) * HOT_KEYS > total) & (F.col(n) >= HOT_ROWS)
    hot, cold = right.filter(is_hot), right.filter(~is_hot).hint("merge")
    if not hot.head(1):
        return left.join(cold, keys, how)
    others = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    if how == "left_anti":
        return others
    return left.join(F.broadcast(hot), keys, "left_semi" if how == "left_semi" else "inner").unionByName(others)


def sieved_join(left: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """The rows of left, which may be wide, whose key stands in the one column of keys (left_semi) or does not (left_anti).

    Each key marks one bit of SIEVE_WORDS words, which are broadcast: rows whose bit is not set hold none of the keys and
    need no shuffle. Only the others meet the keys in a sort-merge join, so the result is exact however many bits are set.
    keys should be a table, for it is read twice; keys are never null.
    """
    hashed = F.xxhash64(key, F.lit(7))
    word = F.pmod(hashed, F.lit(SIEVE_WORDS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(hashed, 40), F.lit(64)).cast("int"))
    marks = keys.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    sieved = left.withColumn("_word", word).join(F.broadcast(marks), "_word", "left")
    held = F.coalesce(F.col("_bits"), F.lit(0).cast("long")).bitwiseAND(bit) != 0
    met = sieved.filter(held).select(*left.columns).join(keys.select(key).hint("merge"), key, how)
    return met if how == "left_semi" else met.unionByName(sieved.filter(~held).select(*left.columns))


def ordered_rows(docs: DataFrame, id_col: str, text_col: str, carry: list[str] = ()) -> DataFrame:
    """doc_id, text (never null) and doc, a long that orders the rows by id and tells them apart; columns to carry along
    are named _carry_ and their name.

    Where ids are whole numbers, unique and never null, they serve themselves. Else (ids of other types too) the rows are written
    in order (null ids last, equal ids by a hash of their text) and numbered.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"_carry_{c}") for c in carry])
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        n, named, different = rows.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
        if n == named == different:
            return rows.withColumn("doc", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("_place")]  # the place deals out rows that are all alike
    ordered = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_place")
    return written(ordered.withColumn("doc", F.monotonically_increasing_id()), "ordered-rows")
