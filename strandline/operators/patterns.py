"""Many patterns at once: substrings by one pass of an automaton over each text, prefixes by an equality join for each length.

The work does not grow with the number of patterns: a text is read once however many there are. Patterns are data, a table of the caller's.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.tables import stored

#: Patterns of so many characters in all are sent to the tasks; more are joined.
AUTOMATON_CHARS = 1_000_000
#: Texts whose matches are held at once.
TEXTS = 64


def _distinct(patterns: DataFrame, pattern_col: str) -> DataFrame:
    """pattern: each once; null and empty ones match nothing."""
    return patterns.select(F.col(pattern_col).alias("pattern")).filter("pattern <> ''").distinct()


def _automaton(patterns: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for p in patterns:
        made.add_word(p, p)
    made.make_automaton()
    return made


def _counted(found: Iterable[tuple[int, str]]) -> dict[str, list[int]]:
    """pattern -> [n, place, end] of its matches (last character, pattern): those from the left that do not overlap."""
    of: dict[str, list[int]] = {}
    for last, p in found:
        begin = last + 1 - len(p)
        seen = of.get(p)
        if seen is None:
            of[p] = [1, begin + 1, last + 1]
        elif begin >= seen[2]:
            seen[0] += 1
            seen[2] = last + 1
    return of


def _by_automaton(docs: DataFrame, patterns: list[str]) -> DataFrame:
    if not patterns:
        return docs.select("id", F.lit("").alias("pattern"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("place")).limit(0)
    schema = StructType([docs.schema["id"], *StructType.fromDDL("pattern string, n long, place long")])
    target = to_arrow_schema(schema)
    sent = docs.sparkSession.sparkContext.broadcast(patterns)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = _automaton(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                rows = [(i, p, n, place) for i, s in enumerate(part.column("text").to_pylist()) if s for p, (n, place, _) in _counted(search.iter(s)).items()]
                ids = part.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.cast(target.field(0).type), *[pa.array([r[k] for r in rows], target.field(k).type) for k in (1, 2, 3)]], schema=target)

    return docs.mapInArrow(apply, schema)


def _by_join(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """Texts meet patterns in the patterns' first characters, as many as the shortest has; the rest is compared."""
    least = patterns.agg(F.min(F.length("pattern")).alias("n")).first().n or 1
    grams = docs.filter(F.length("text") >= least).select("id", "text", F.explode(F.sequence(F.lit(1), F.length("text") - least + 1)).alias("place"))
    longest = patterns.agg(F.max(F.length("pattern")).alias("n")).first().n or 1
    # What follows a place, as far as any pattern reaches, goes along in place of the text.
    follows = grams.select("id", "place", F.substring("text", F.col("place"), F.lit(longest)).alias("ahead")).withColumn("gram", F.substring("ahead", 1, least))
    met = follows.join(patterns.withColumn("gram", F.substring("pattern", 1, least)), "gram").filter(F.startswith("ahead", "pattern"))
    places = met.groupBy("id", "pattern").agg(F.array_sort(F.collect_list("place")).alias("places"))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(1).alias("end"))
    apart = lambda a, x: F.when(x >= a["end"], F.struct((a["n"] + 1).alias("n"), (x + F.length("pattern")).alias("end"))).otherwise(a)
    return places.select("id", "pattern", F.aggregate("places", none, apart)["n"].alias("n"), F.get("places", F.lit(0)).cast("long").alias("place"))


def substring_matches(docs: DataFrame, id_col: str, text: Column, patterns: DataFrame, pattern_col: str = "pattern", most_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """(id_col, pattern, n, place): which patterns each text holds, how often (from the left, without overlaps of a pattern with itself)
    and where first (characters, from 1). Other patterns may overlap. A null or empty text holds none; a pattern that comes twice is one.

    Patterns whose characters are counted to fit most_chars are sent to the tasks as an automaton, and nothing is shuffled; more are
    joined by their first characters. The rows are the same.
    """
    given = stored(_distinct(patterns, pattern_col), "patterns")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    chars = given.agg(F.sum(F.length("pattern")).alias("n")).first().n or 0
    found = _by_automaton(rows, [r.pattern for r in given.collect()]) if chars <= most_chars else _by_join(rows, given)
    return found.withColumnRenamed("id", id_col)


def first_prefix(rows: DataFrame, id_col: str, on: Column, prefixes: DataFrame, prefix_col: str, order_col: str) -> DataFrame:
    """(id_col, prefix_col): of the prefixes that a value begins with, the one with the smallest order (ties: the smaller prefix); null if
    none. A null value begins with nothing, an empty prefix begins everything, and a null prefix counts nowhere.

    A value is cut to each length that a prefix has and joined by equality; there are as many cuts as the prefixes have lengths.
    """
    rules = stored(prefixes.select(F.col(prefix_col).alias("prefix"), F.col(order_col).alias("o")).filter("prefix IS NOT NULL").groupBy("prefix").agg(F.min("o").alias("o")), "prefixes")
    lengths = [r.n for r in rules.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]
    one = rows.select(F.col(id_col).alias("id"), on.alias("value"))
    if not lengths:
        return one.select(F.col("id").alias(id_col), F.lit(None).cast("string").alias(prefix_col))
    cuts = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("value"))
    cut = one.select("id", F.explode_outer(F.transform(cuts, lambda n: F.substring("value", F.lit(1), n))).alias("prefix"))
    best = cut.join(rules, "prefix", "left").groupBy("id").agg(F.min(F.when(F.col("o").isNotNull(), F.struct("o", "prefix"))).alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("b.prefix").alias(prefix_col))
