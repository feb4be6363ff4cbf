"""Repeated runs of lines by a suffix array over line numbers, sorted by prefix doubling in joins and sorts.

A suffix is a document's lines from one line on. Only lines that occur again can begin a repeated run, so the array holds
the suffixes that begin with one. Sorting them by their first line gives ranks; the ranks of a suffix and of the one k lines on,
sorted as pairs, give the order by 2k lines. Ranks come from one range-partitioned sort per doubling, in which equal keys are one
row. Suffixes that share a rank of depth k are an interval of the array whose longest common prefix is at least k lines: all but
the earliest of an interval begin a later copy of k lines. Depths are the shortest run that counts and its doubles, until no
two suffixes share a rank and the array is settled. Of each suffix the deepest interval tells how long a copy begins there; copies
that touch or overlap join to the maximal runs, which are deleted. All of it is DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keyed_join, ordered_rows, written

#: Lines of the shortest run that counts as repeated; characters from which a single line counts as a run, being a passage.
MIN_LINES, MIN_CHARS = 2, 300


def _ranked(suffixes: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """doc, i, r, d0, i0, depth, chars of the suffixes whose key occurs again; r ascends with the key and is one number per key.

    d0 and i0: the earliest suffix with that key.
    """
    again = suffixes.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct("doc", "i")).alias("first")).filter("n > 1")
    intervals = again.select(*keys, "n", F.col("first.doc").alias("d0"), F.col("first.i").alias("i0"))
    ranks = written(intervals.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), "ranks")
    found = keyed_join(suffixes.select("doc", "i", "chars", *keys), ranks, keys, "inner")
    return written(found.select("doc", "i", F.col("rank").alias("r"), "d0", "i0", F.lit(depth).alias("depth"), "chars"), "suffixes")


def _beside(suffixes: DataFrame, k: int) -> DataFrame:
    """Suffixes with the rank s of the suffix k lines on, where the array holds that."""
    on = Window.partitionBy("doc").orderBy("i").rangeBetween(k, k)  # within one document
    return suffixes.withColumn("s", F.first("r").over(on)).filter("s IS NOT NULL").select("doc", "i", "chars", "r", "s")


def suffix_array(rows: DataFrame, min_lines: int = MIN_LINES) -> list[DataFrame]:
    """The levels of the array over documents (doc, text): doc, i, r, d0, i0, depth, chars of the suffixes that share their
    first depth lines with another; depths are 1, the doubles of that up to min_lines, and the doubles of min_lines."""
    lines = rows.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    named = lines.select("doc", F.col("i").cast("long").alias("i"), F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), F.length("line").alias("chars"))
    levels, depth = [_ranked(written(named, "lines"), ["a", "b"], 1)], 1
    while levels[-1].head(1):
        step = min(depth, min_lines - depth) if depth < min_lines else depth  # the last pair below min_lines may overlap
        depth += step
        levels.append(_ranked(_beside(levels[-1], step), ["r", "s"], depth))
    return levels


def repeated_runs(rows: DataFrame, min_lines: int = MIN_LINES, min_chars: int | None = MIN_CHARS) -> DataFrame:
    """(doc, runs): the maximal runs of lines, as structs of first line a and line after the last b, that later copies make up."""
    counts = F.col("depth") >= min_lines
    if min_chars is not None:
        counts |= (F.col("depth") == 1) & (F.col("chars") >= min_chars)
    later = [level.filter(counts & ((F.col("doc") != F.col("d0")) | (F.col("i") != F.col("i0")))).select("doc", "i", "depth") for level in suffix_array(rows, min_lines)]
    deepest = reduce(DataFrame.unionByName, later).groupBy("doc", "i").agg(F.max("depth").alias("depth"))
    copies = written(deepest, "later-copies")
    before = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("doc").orderBy("i")
    reached = copies.withColumn("reach", F.max(F.col("i") + F.col("depth")).over(before))
    numbered = reached.withColumn("run", F.sum(F.when(F.col("reach") >= F.col("i"), 0).otherwise(1)).over(so_far))
    runs = numbered.groupBy("doc", "run").agg(F.min("i").alias("a"), F.max(F.col("i") + F.col("depth")).alias("b"))
    return written(runs.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs")), "repeated-runs")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_chars: int | None = MIN_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, n_runs, kept_text.

    A line goes when it lies in a run of min_lines lines of its document that also starts earlier (in a smaller doc_id, or
    earlier in the same document), or has min_chars characters (None: no such rule) and occurs earlier; copies that overlap
    count, and runs are judged on the input. n_runs counts maximal removed runs. Lines end at line feeds; a null or empty text is
    one empty line, very long texts are many lines like any other. Ids may be of any type that sorts. Rows that share an id count
    as earlier and later in the order of a hash of their texts, null ids come last. An empty table gives no rows; other columns are
    not read.
    """
    rows = ordered_rows(docs, id_col, text_col)
    found = rows.join(repeated_runs(rows.select("doc", "text"), min_lines, min_chars).hint("merge"), "doc", "left")
    runs = found.select("doc_id", F.split("text", "\n", -1).alias("lines"), "runs")
    size = F.size("lines").cast("long")
    # what stands between the runs, from each run's end to the next one's begin
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("runs", lambda r: r["b"]))
    begins = F.concat(F.transform("runs", lambda r: r["a"]), F.array(size))
    between = F.flatten(F.zip_with(ends, begins, lambda a, b: F.slice("lines", (a + 1).cast("int"), (b - a).cast("int"))))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    none = F.col("runs").isNull()
    return runs.select(
        "doc_id",
        size.alias("n_lines"),
        F.when(none, F.lit(0)).otherwise(removed).cast("long").alias("n_removed"),
        F.when(none, F.lit(0)).otherwise(F.size("runs")).cast("long").alias("n_runs"),
        F.array_join(F.when(none, F.col("lines")).otherwise(between), "\n").alias("kept_text"),
    )
