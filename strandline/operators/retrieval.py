"""Retrieval: postings, BM25, dense neighbours, fusion, quotas, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text


def postings(docs: DataFrame, tokens=text.bm25_tokens) -> DataFrame:
    """doc_id, dl, term, tf: how often each term stands in each document, and the document's length.

    Partial aggregation counts a document's terms in the task that has it.
    """
    rows = docs.select("doc_id", tokens(F.col("text")).alias("t")).withColumn("dl", F.size("t"))
    return rows.select("doc_id", "dl", F.explode("t").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def term_frequencies(docs: DataFrame, tokens=text.bm25_tokens) -> DataFrame:
    """term, df, cf: documents that hold each term, and how often all do. One shuffle, of terms counted in the tasks."""
    ordered = F.array_sort("t")
    rows = docs.select(tokens(F.col("text")).alias("t")).select(ordered.alias("o"))
    marked = rows.select(F.explode(F.transform("o", lambda w, i: F.struct(w.alias("term"), ((i == 0) | (F.get("o", F.greatest(i - 1, F.lit(0))) != w)).cast("long").alias("new")))).alias("x"))
    return marked.groupBy("x.term").agg(F.sum("x.new").alias("df"), F.count("*").alias("cf"))


def top(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key with their rank; Spark cuts each partition to k before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def fused(lists: list[tuple[DataFrame, float]], keys: list[str], k: int = scores.RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of ranked lists (keys, rank): keys, score."""
    parts = [df.select(*keys, (F.lit(w) / (k + F.col("rank"))).alias("part")) for df, w in lists]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy(*keys).agg(F.round(F.sum("part"), 8).alias("score"))


def concatenated(hits: DataFrame, key: str, variant: str, rank: str = "rank") -> DataFrame:
    """hits of a question's variants, each ranked by itself, with place: their rank in the variants' lists put one after the other.

    A document that several variants find has a place for each. A question has as many rows as its variants have hits, so lists must be cut first.
    """
    return hits.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(variant, rank)))


def limited(hits: DataFrame, key: list[str], order: list[Column], most: int, when: Column) -> DataFrame:
    """hits without those that are not among the ``most`` best of their key; rows for which ``when`` is not true are all kept."""
    place = F.row_number().over(Window.partitionBy(*key, F.coalesce(when, F.lit(False))).orderBy(*order))
    return hits.withColumn("__place", place).filter(~F.coalesce(when, F.lit(False)) | (F.col("__place") <= most)).drop("__place")


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top(rows, keys, order, 1).drop("rank")


def quota_pick(rows: DataFrame, keys: list[str], kind: str, kinds: list[str], order: list[Column], k: int) -> DataFrame:
    """The best row of each of some kinds, then the best of the rest, k rows in all, in order."""
    of_kind = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(*order))
    chosen = rows.withColumn("first_pick", (of_kind == 1) & F.col(kind).isin(kinds))
    picked = top(chosen, keys, [F.desc("first_pick"), *order], k).drop("rank", "first_pick")
    return picked.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def token_budget(rows: DataFrame, keys: list[str], order: list[Column], budget: int, overhead: int = 20, least: int = 100) -> DataFrame:
    """Rows in order while their tokens and overhead fit the budget; the first that overflows is cut to what is left if that is
    more than least, and nothing follows it. Columns added: taken_tokens, truncated.

    Each row costs the overhead at least, so no key needs more rows than the budget has overheads, and one that overflows.
    """
    if overhead > 0:
        rows = top(rows, keys, order, budget // overhead + 1).drop("rank")
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.withColumn("total", F.sum(F.col("tokens") + overhead).over(w)).withColumn("before", F.col("total") - F.col("tokens") - overhead)
    left = F.lit(budget) - F.col("before") - overhead
    overflow = F.sum((F.col("total") > budget).cast("int")).over(w)
    kept = sums.withColumn("nth", overflow).withColumn("left", left).filter((F.col("nth") == 0) | ((F.col("nth") == 1) & (F.col("total") > budget) & (F.col("left") > least)))
    return kept.withColumn("truncated", F.col("nth") == 1).withColumn("taken_tokens", F.when(F.col("nth") == 1, F.col("left")).otherwise(F.col("tokens"))).drop("nth", "left", "total", "before")


def greedy_distinct(rows: DataFrame, key: str, id_col: str, most: float) -> DataFrame:
    """(key, id): rows (key, rank, words) of short ranked lists without those too like one kept before them, in order.

    A list is one array, so it must be short: rank it and cut it first.
    """
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", F.col(id_col).alias("id"), "words"))).alias("l"))
    none = F.filter("l", lambda x: F.lit(False))
    kept = F.aggregate("l", none, lambda a, x: F.when(F.exists(a, lambda y: text.jaccard(x["words"], y["words"]) > most), a).otherwise(F.concat(a, F.array(x))))
    return lists.select(key, F.explode(kept).alias("x")).select(key, F.col("x.id").alias(id_col))
