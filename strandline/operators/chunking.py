"""One text to many chunks: by words, sections, tables, steps and problems, as windows over numbered lines.

A document is exploded to lines once; each chunker is then a running count or sum over the lines of a document and a grouping by
it, so all of them share one partitioning by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a line is, by the first pattern that it matches: the caller's to replace.
LINE_KINDS = {"header": r"^#{1,4} ", "warning": r"^(WARNING|CAUTION):", "problem": r"^Problem:", "solution": r"^Solution:", "step": r"^[0-9]+\. ", "table": r"\|.*\|", "blank": r"^ *$"}
#: How each type of document is cut, and the estimated tokens of a chunk.
STRATEGIES = {"manual": ("sections", 60), "guide": ("sections", 60), "bulletin": ("problems", 60), "procedure": ("steps", 60), "spec": ("tables", 60), "error_list": ("tables", 60), "compatibility": ("tables", 60), "general": ("segments", 60)}


def word_windows(text: str | None, budget: int, overlap: int) -> Iterator[str]:
    """Windows of words whose estimated tokens (a quarter of a word's characters, and one) fit the budget.

    A window begins a quarter of the overlap (rounded up) in words before the end of the one before, and holds one new word at
    least. Ends are searched in the running sum of the costs.
    """
    words = (text or "").split()
    spent = np.concatenate(([0], np.cumsum([len(w) // 4 + 1 for w in words], dtype=np.int64)))
    again, begin, end = (overlap + 3) // 4, 0, 0
    while end < len(words):
        end = max(end + 1, int(np.searchsorted(spent, spent[begin] + budget, side="right")) - 1)
        yield " ".join(words[begin:end])
        begin = max(begin + 1, end - again)


def split_by_words(df: DataFrame, text_col: str = "text", budget: int = 400, overlap: int = 0) -> DataFrame:
    """df without its text, one row per chunk: seq (from 0), chunk. Texts without words give no row."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(word_windows(t, budget, overlap)))

    rest = [F.col(f"`{c}`") for c in df.columns if c != text_col]
    return df.select(*rest, F.posexplode(cut(F.col(text_col))).alias("seq", "chunk"))


def grouped_entries(df: DataFrame, key: str, order: list[str], line: Column, size: int = 5) -> DataFrame:
    """(key, seq, chunk): lines of each key, in order, so many to a chunk.

    The window ranks lines within a key; a chunk gathers at most ``size`` of them.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    placed = df.select(key, *[c for c in order if c != key], line.alias("_line")).withColumn("_place", place)
    chunks = placed.groupBy(key, F.floor(F.col("_place") / size).alias("seq")).agg(F.sort_array(F.collect_list(F.struct("_place", "_line"))).alias("_lines"))
    return chunks.select(key, "seq", F.array_join(F.col("_lines._line"), "\n").alias("chunk"))


def typed(lines: DataFrame, kinds: dict[str, str] = LINE_KINDS) -> DataFrame:
    """lines (doc_id, i, line) with kind, and tokens as estimated."""
    first = F.coalesce(*[F.when(F.col("line").rlike(p), F.lit(name)) for name, p in kinds.items()], F.lit("text"))
    return lines.withColumn("kind", first).withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("line") / 4)).cast("long"))


def in_order() -> Window:
    return Window.partitionBy("doc_id").orderBy("i")


def _joined(lines: DataFrame, *keys: str, **more: Column) -> DataFrame:
    """One chunk per document and keys: its lines in order, and further aggregates."""
    found = lines.groupBy("doc_id", *keys).agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("_l"), *[c.alias(n) for n, c in more.items()])
    return found.select("doc_id", *keys, F.array_join(F.col("_l.line"), "\n").alias("chunk"), *more)


def sections(lines: DataFrame, budget: int = 60) -> DataFrame:
    """(doc_id, section, part, heading, chunk, tokens, has_procedure): a header begins a section; a section larger than the budget is
    cut into parts, a line going to the part in which its first token falls. lines are typed()."""
    placed = lines.withColumn("section", F.sum((F.col("kind") == "header").cast("long")).over(in_order()))
    within = Window.partitionBy("doc_id", "section").orderBy("i")
    cut = placed.withColumn("heading", F.first(F.when(F.col("kind") == "header", F.regexp_replace("line", "^#+ ", ""))).over(within))
    cut = cut.withColumn("part", F.floor((F.sum("tokens").over(within) - F.col("tokens")) / budget))
    return _joined(cut, "section", "part", heading=F.min("heading"), tokens=F.sum("tokens"), has_procedure=F.count_if(F.col("kind") == "step") >= 3)


def blocks(lines: DataFrame, kind: str) -> DataFrame:
    """The lines of a kind with block, the number of their unbroken run in the document, and place within it from 1."""
    starts = (F.col("kind") == kind) & (F.lag("kind", 1, "").over(in_order()) != kind)
    runs = lines.withColumn("block", F.sum(starts.cast("long")).over(in_order())).filter(F.col("kind") == kind)
    return runs.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "block").orderBy("i")))


def table_chunks(lines: DataFrame, rows: int = 5) -> DataFrame:
    """(doc_id, block, part, chunk, n_rows): table rows in groups, each under the table's first row as its header."""
    placed = blocks(lines, "table").withColumn("header", F.first("line").over(Window.partitionBy("doc_id", "block").orderBy("i")))
    body = placed.filter("place > 1").withColumn("part", F.floor((F.col("place") - 2) / rows))
    found = _joined(body, "block", "part", header=F.min("header"), n_rows=F.count("*"))
    return found.select("doc_id", "block", "part", F.concat_ws("\n", "header", "chunk").alias("chunk"), "n_rows")


def steps(lines: DataFrame) -> DataFrame:
    """(doc_id, i, number, last): each step and the last line before the next step or the end of the document."""
    number = F.regexp_extract("line", "^([0-9]+)", 1).cast("long")
    marked = lines.withColumn("end", F.max("i").over(Window.partitionBy("doc_id"))).filter("kind = 'step'")
    return marked.select("doc_id", "i", number.alias("number"), F.coalesce(F.lead("i").over(in_order()) - 1, F.col("end")).alias("last"))


def step_chunks(lines: DataFrame, most: int = 5) -> DataFrame:
    """(doc_id, part, label, chunk, warned): steps with what follows them, so many to a chunk; a warning among them is flagged."""
    numbered = lines.withColumn("step", F.sum((F.col("kind") == "step").cast("long")).over(in_order())).filter("step > 0")
    part = F.floor((F.col("step") - 1) / most)
    nth = F.when(F.col("kind") == "step", F.col("step"))
    found = _joined(numbered.withColumn("part", part), "part", low=F.min(nth), high=F.max(nth), warned=F.count_if(F.col("kind") == "warning") > 0)
    return found.select("doc_id", "part", F.concat_ws("-", "low", "high").alias("label"), "chunk", "warned")


def problem_pairs(lines: DataFrame) -> DataFrame:
    """(doc_id, i, problem, solution): each problem line with the next solution line before another problem."""
    marked = lines.filter("kind IN ('problem', 'solution')")
    after = marked.withColumn("next_kind", F.lead("kind").over(in_order())).withColumn("next_line", F.lead("line").over(in_order()))
    bare = lambda c: F.trim(F.regexp_replace(c, "^[A-Za-z]+:", ""))
    return after.filter("kind = 'problem' AND next_kind = 'solution'").select("doc_id", "i", bare("line").alias("problem"), bare("next_line").alias("solution"))


def segments(lines: DataFrame) -> DataFrame:
    """(doc_id, segment, kind, chunk, tokens): unbroken runs of tables, of steps, and of all else."""
    kind = F.when(F.col("kind").isin("table", "step"), F.col("kind")).otherwise("text")
    named = lines.withColumn("kind", kind)
    new = F.lag("kind", 1, "").over(in_order()) != F.col("kind")
    return _joined(named.withColumn("segment", F.sum(new.cast("long")).over(in_order())), "segment", kind=F.min("kind"), tokens=F.sum("tokens"))


def section_paths(lines: DataFrame) -> DataFrame:
    """(doc_id, section, path): the headings from the document's first to the section's own, those of higher levels that hold it
    between them; a heading's level is the number of its #."""
    heads = lines.filter("kind = 'header'").withColumn("level", F.length(F.regexp_extract("line", "^(#+)", 1))).withColumn("name", F.regexp_replace("line", "^#+ ", ""))
    placed = heads.withColumn("section", F.row_number().over(in_order()).cast("long"))
    above = [F.last(F.when(F.col("level") == n, F.struct("section", "name")), ignorenulls=True).over(in_order()) for n in range(1, 5)]
    held = placed.select("doc_id", "section", "level", "name", F.first("name").over(in_order()).alias("first"), *[a.alias(f"h{n}") for n, a in enumerate(above, 1)])
    # a heading above holds the section unless a higher one came between them
    parts = [F.when((F.col("level") > n) & (F.col(f"h{n}.section") >= F.greatest(F.lit(0), F.lit(0), *[F.coalesce(F.col(f"h{m}.section"), F.lit(0)) for m in range(1, n)])), F.col(f"h{n}.name")) for n in range(1, 4)]
    whole = F.array_distinct(F.array_compact(F.array("first", *parts, "name")))
    return held.select("doc_id", "section", F.array_join(whole, " > ").alias("path"))


#: What a chunk is by the share or number of its kinds of lines: name -> (kind, least number, least share). The first that holds.
CHUNK_TYPES = {"table": ("table", 1, 0.3), "procedure": ("step", 2, 0.0), "solution": ("solution", 1, 0.0), "warning": ("warning", 1, 0.2)}


def chunk_types(lines: DataFrame, keys: list[str], types: dict[str, tuple[str, int, float]] = CHUNK_TYPES, default: str = "text") -> DataFrame:
    """(keys, n_lines, type) of the chunks that the keys tell apart."""
    counts = lines.groupBy(*keys).agg(F.count("*").alias("n_lines"), *[F.count_if(F.col("kind") == k).alias(f"_{name}") for name, (k, _, _) in types.items()])
    first = F.coalesce(*[F.when((F.col(f"_{name}") >= n) & (F.col(f"_{name}") >= share * F.col("n_lines")), F.lit(name)) for name, (_, n, share) in types.items()], F.lit(default))
    return counts.select(*keys, "n_lines", first.alias("type"))


def merged_small(chunks: DataFrame, order: list[str], least: int) -> DataFrame:
    """(doc_id, seq, chunk, tokens): neighbouring chunks (chunk, tokens) appended to one another until they hold ``least`` tokens.

    The chunks of a document are one array and folded in order; what is left at its end is a chunk too.
    """
    lists = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*order, "chunk", "tokens"))).alias("l"))
    one = "array<struct<chunk:string,tokens:bigint>>"
    start = F.array().cast(one)

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        new = F.struct(x["chunk"].alias("chunk"), x["tokens"].alias("tokens"))
        both = F.struct(F.concat(last["chunk"], F.lit("\n"), x["chunk"]).alias("chunk"), (last["tokens"] + x["tokens"]).alias("tokens"))
        open_ = (F.size(done) > 0) & (F.coalesce(last["tokens"], F.lit(least)) < least)
        return F.when(open_, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(new)))

    # the last of an empty list is null, not an error
    found = lists.select("doc_id", F.aggregate("l", start, lambda a, x: F.when(F.size(a) == 0, F.array(F.struct(x["chunk"].alias("chunk"), x["tokens"].alias("tokens")))).otherwise(step(a, x))).alias("m"))
    return found.select("doc_id", F.posexplode("m").alias("seq", "c")).select("doc_id", "seq", "c.chunk", "c.tokens")


def by_strategy(lines: DataFrame, strategies: dict[str, tuple[str, int]] = STRATEGIES) -> DataFrame:
    """(doc_id, strategy, a, b, chunk): lines with document_type, each document cut as its type asks; a and b order the chunks."""
    named = F.coalesce(*[F.when(F.col("document_type") == t, F.lit(s)) for t, (s, _) in strategies.items()], F.lit("segments"))
    dealt = lines.withColumn("strategy", named)
    own = lambda s: dealt.filter(F.col("strategy") == s).drop("strategy", "document_type")
    budget = next(b for s, b in strategies.values() if s == "sections")
    zero = F.lit(0).cast("long")
    parts = [
        sections(own("sections"), budget).select("doc_id", F.lit("sections").alias("strategy"), F.col("section").alias("a"), F.col("part").alias("b"), "chunk"),
        problem_pairs(own("problems")).select("doc_id", F.lit("problems").alias("strategy"), F.col("i").cast("long").alias("a"), zero.alias("b"), F.concat_ws("\n", "problem", "solution").alias("chunk")),
        step_chunks(own("steps")).select("doc_id", F.lit("steps").alias("strategy"), F.col("part").alias("a"), zero.alias("b"), "chunk"),
        table_chunks(own("tables")).select("doc_id", F.lit("tables").alias("strategy"), F.col("block").alias("a"), F.col("part").alias("b"), "chunk"),
        segments(own("segments")).select("doc_id", F.lit("segments").alias("strategy"), F.col("segment").alias("a"), zero.alias("b"), "chunk"),
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found
