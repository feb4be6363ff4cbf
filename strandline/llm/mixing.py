"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Sources share a number of words by weight; what exceeds so many times a source's size is shared anew. The blocks go to the sources
by highest quotients (target over 1, 3, 5, ...), then each source's blocks to its shards in the same way, by their sizes. A shard
is a stream of documents cut into blocks of equal length; each is taken as often as the shard's quota allows evenly, and those
that are taken once more have the smallest seeded hashes. A document gets the words of the blocks that cover it.

The seats are not dealt one by one: two divisors, so near to each other that they differ by two seats or so a claimant, give all
seats but the last few of each, and only these are ranked. Sources, shards and seats stay in tables, however many there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import keyed_join, ordered_rows, written

#: Words of a block, and documents and words of a shard (about).
BLOCK_WORDS, SHARD_DOCS, SHARD_WORDS = 16, 1000, 1_000_000
WORDS = r"[^\x20\x09-\x0D]+"


def numbered(table: DataFrame, order: list[Column], name: str) -> DataFrame:
    """table with a column of row numbers from 0 in this order, which should leave no ties; no task sees more than its range."""
    ranged = table.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    placed = written(ranged, "numbered")
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    at = F.col("_before") + F.col("_place") - F.shiftleft(F.col("_part"), 33)
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, at).drop("_part", "_place", "_before")


def with_targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """sources (size, weight) with target: share times all sizes by weight, none above most times its size.

    What is above is shared by weight among the others, until none is above: one aggregation for each time.
    """
    total, weights = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, last = (share * total / weights if weights else 0.0), None
    while level != last:
        above = F.col("size") * most < F.col("weight") * F.lit(level)
        full, gone = sources.agg(F.coalesce(F.sum(F.when(above, F.col("size") * most)), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("weight"))), F.lit(0))).first()
        if gone == weights:
            break
        level, last = (share * total - full) / (weights - gone), level
    return sources.withColumn("target", F.least((F.col("size") * most).cast("double"), F.col("weight") * F.lit(level)))


def apportioned(claims: DataFrame) -> DataFrame:
    """claims (key, part, votes, cap, seats) with quota: the seats of a key, which all its rows repeat, by Sainte-Lague's method.

    A seat k of a part has the quotient votes / (2k - 1), and a part gets cap seats at most; the highest quotients of a key win, of
    equal ones the smaller part's. key and part name a row; seats beyond all caps stay free.
    """
    claims = written(claims, "claims")
    keys = claims.groupBy("key").agg(F.first("seats").alias("asked"), F.sum("votes").alias("all"), F.sum("cap").alias("room"), F.count("*").alias("n"))
    keys = keys.withColumn("asked", F.least("asked", "room")).withColumn("more", F.lit(0).cast("long"))
    few, many = F.col("asked") - F.col("n") / 2 - 1, F.col("asked") + F.col("n") / 2 + 1 + F.col("more")

    def seats(divisor: Column) -> Column:
        return F.least(F.col("cap"), F.floor(F.col("votes") * divisor / F.col("all") + 0.5))

    while True:
        keys = written(keys, "keys")
        dealt = keyed_join(claims, keys, ["key"], "inner")
        dealt = dealt.withColumn("sure", F.when((few > 0) & (F.col("all") > 0), seats(few)).otherwise(F.lit(0)))
        dealt = dealt.withColumn("likely", F.when(F.col("all") > 0, F.greatest(seats(many), "sure")).otherwise(F.lit(0)))
        sums = dealt.groupBy("key").agg(F.sum("sure").alias("given"), F.sum("likely").alias("able"), F.max("asked").alias("asked"))
        sums = written(sums, "sums")
        short = sums.filter((F.col("able") < F.col("asked")) & (F.col("able") > F.col("given"))).select("key", (F.col("asked") - F.col("able")).alias("short"))
        if not short.head(1):
            break
        lacking = keys.join(short, "key", "left")  # caps bound so many seats: the others' divisor must give them too
        keys = lacking.withColumn("more", F.col("more") + F.coalesce(2 * F.col("short"), F.lit(0))).drop("short")
    open_seats = dealt.filter("likely > sure").select("key", "part", F.explode(F.sequence(F.col("sure") + 1, F.col("likely"))).alias("k"), "votes")
    open_seats = open_seats.withColumn("quotient", F.col("votes") / (2 * F.col("k") - 1))
    ranked = numbered(open_seats, [F.col("key"), F.desc("quotient"), F.col("part"), F.col("k")], "at")
    firsts = ranked.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    limits = written(firsts.join(sums, "key").select("key", "n", (F.col("first") + F.col("asked") - F.col("given")).alias("end")), "limits")
    won = keyed_join(ranked, limits, ["key"], "inner").filter("at < end").groupBy("key", "part").agg(F.count("*").alias("won"))
    found = dealt.join(won, ["key", "part"], "left").withColumn("quota", F.col("sure") + F.coalesce("won", F.lit(0)))
    return written(found.select(*claims.columns, "quota"), "quotas")


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit number for each."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_copies(blocks: int, quota: int, seed: int) -> np.ndarray:
    """How often each block of a shard is taken: all equally often, and those with the smallest hashes once more."""
    every, rest = divmod(quota, blocks) if blocks else (0, 0)
    order = np.argsort(mix(np.arange(blocks, dtype=np.uint64) ^ mix(np.array([seed], np.int64).view(np.uint64))), kind="stable")
    copies = np.full(blocks, every, np.int64)
    copies[order[:rest]] += 1
    return copies


def words_taken(sizes: np.ndarray, copies: np.ndarray, block_words: int) -> np.ndarray:
    """Words that each document of a stream gives, its blocks being taken so often."""
    ends = np.concatenate(([0], np.cumsum(sizes)))
    before = np.concatenate(([0], np.cumsum(copies))) * block_words
    block, within = np.divmod(ends, block_words)
    return np.diff(before[block] + np.append(copies, 0)[block] * within)


def mixed_sources(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7,
    block_words: int = BLOCK_WORDS, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: a row for each row of docs.

    Sizes count words. Sources, ordered by code point with null last, have the weights in turn and share ``share`` times all words,
    none more than most times its own. A source misses its target by about a block, and by one more for each of its shards.

    A null text has no words and gives none; null is a source like any other. Rows with null or repeated ids count each
    (ordered_rows() tells them apart). Equal quotients and equal hashes go to the earlier source, shard or block. The result depends
    on the rows and the seed alone, not on how they are dealt to tasks. An empty table gives no rows; other columns are not read.
    """
    size = F.regexp_count("text", F.lit(WORDS)).cast("long")
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))  # nulls last
    rows = ordered_rows(docs, id_col, text_col, carry=[source_col]).withColumnRenamed(f"_carry_{source_col}", "source")
    sized = written(rows.select("doc_id", "doc", "source", key.alias("key"), size.alias("size")), "sized")

    totals = sized.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    placed = numbered(totals, [F.col("key")], "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int") + 1)
    sources = written(with_targets(written(placed.withColumn("weight", weight), "sources"), share, most), "targets")
    blocks = int((sources.agg(F.sum("target")).first()[0] or 0.0) / block_words + 0.5)
    cap = most * F.ceil(F.col("size") / block_words)
    quotas = apportioned(sources.select(F.lit(0).alias("key"), F.col("key").alias("part"), F.col("target").alias("votes"), cap.alias("cap"), F.lit(blocks).cast("long").alias("seats")))

    shards = F.greatest(F.ceil(F.col("n") / shard_docs), F.ceil(F.col("source_size") / shard_words), F.lit(1))
    known = sources.join(quotas.select(F.col("part").alias("key"), F.col("quota").alias("seats")), "key")
    known = written(known.select("key", "n", "seats", "target", F.col("size").alias("source_size")), "known").withColumn("shards", shards)
    dealt = keyed_join(sized, known, ["key"], "inner").withColumn("part", F.pmod(F.xxhash64("doc", F.lit(seed)), F.col("shards")))
    dealt = written(dealt.select("doc_id", "doc", "source", "key", "part", "size", "source_size", "target", "seats"), "dealt")
    cells = dealt.groupBy("key", "part").agg(F.sum("size").alias("size"), F.first("seats").alias("seats"))
    cells = apportioned(cells.select("key", "part", F.col("size").cast("double").alias("votes"), cap.alias("cap"), "seats"))
    cells = cells.select("key", "part", "quota", F.xxhash64("key", "part", F.lit(seed)).alias("seed"))

    names = ["doc_id", "source", "size", "source_size", "target"]
    schema = StructType([*[dealt.schema[c] for c in names], *StructType.fromDDL("taken long")])
    target = to_arrow_schema(schema)

    def take(stream: pa.Table, cell: pa.Table) -> pa.Table:
        stream = stream.sort_by("doc")
        sizes = stream.column("size").to_numpy()
        copies = block_copies(-(-int(sizes.sum()) // block_words), *[cell.column(c)[0].as_py() for c in ("quota", "seed")])
        taken = words_taken(sizes, copies, block_words)
        return pa.table([*[stream.column(c) for c in names], pa.array(taken, pa.int64())], schema=target)

    return dealt.groupBy("key", "part").cogroup(cells.groupBy("key", "part")).applyInArrow(take, schema)
