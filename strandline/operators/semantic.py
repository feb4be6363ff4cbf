"""Documents to chunks by meaning: sections, paragraphs, sentences, word windows; and regions of other kinds by chunkers of their own.

A document stays one row: splitting is done by column expressions on arrays, and only the folds whose outcome depends on what
came before (packing under a budget, merging what is small, headings above, regions that overlap) are small Python helpers.
Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.tables import stored
from .chunking import word_windows

#: What makes a line of up to 100 characters a header, by the first pattern that fits.
HEADERS = {
    "numbered": r"(\d+\.)+\d*[ \t]+\p{Lu}",
    "chapter": r"(Chapter|Section|Bölüm|Kısım)[ \t]+\d+",
    "caps": r"\p{Lu}[\p{Lu} \t]{5,50}$",
    "title": r"\p{Lu}\p{Ll}+([ \t]+\p{L}+){2,}$",
    "markdown": r"#{1,6}[ \t]+",
}
#: Lines of a region, the least lines and characters of one, and how many lines (beside a table's header) make a chunk.
REGIONS = {"table": (r"^\|[^\n]+\|\s*$", 2, 0, 5), "procedure": (r"^\s*\d+\.\s+\S", 1, 51, 5), "codes": (r"^[A-Z]{0,5}[-\s]?E?\d{2,4}\s*[:\-]\s*\S", 3, 0, 5)}
#: Stands before each header while a text is cut.
_MARK = "\x1e"


def _unfolded(rows: DataFrame, fold: Callable[..., list[tuple]], nth: str, fields: str) -> DataFrame:
    """Each row's first column, with a numbered row (column nth) for each tuple that fold makes of its other columns."""
    schema = StructType([rows.schema[0], *StructType.fromDDL(f"{nth} int, {fields}")])
    target = to_arrow_schema(schema)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                made = [fold(*x) for x in zip(*[c.to_pylist() for c in some.columns[1:]], strict=True)]
                flat = [(i, n, *x) for i, found in enumerate(made) for n, x in enumerate(found)]
                origin, *columns = zip(*flat, strict=True) if flat else [[]] * len(target)
                arrays = [pa.array(c, f.type) for c, f in zip(columns, list(target)[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(origin, pa.int32())), *arrays], schema=target)

    return rows.mapInArrow(apply, schema)


def cleaned(text: Column) -> Column:
    """Without blank lines in a row, spaces in a row, and space at both ends."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\n{3,}", "\n\n"), " {2,}", " ")
    return F.regexp_replace(one, r"^\s+|\s+$", "")


def _tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def section_texts(text: Column, headers: dict[str, str] = HEADERS) -> Column:
    """The sections of a text in order, each from its header line on; what stands before the first header is one too."""
    header = "|".join(f"(?:{p})" for p in headers.values()).replace("$", r"[ \t]*$")
    marked = F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(" ")), rf"(?m)^(?=[^\n]{{1,100}}$)(?=[ \t]*(?:{header}))", _MARK)
    trimmed = F.transform(F.split(marked, _MARK), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda s: s != "")


def header_of(section: Column, headers: dict[str, str] = HEADERS) -> Column:
    """kind and line of a section's header; kind is body without one."""
    line = F.trim(F.substring_index(section, "\n", 1))
    kind = F.coalesce(*[F.when((F.length(line) <= 100) & line.rlike(f"^(?:{p})"), F.lit(k)) for k, p in headers.items()], F.lit("body"))
    return F.struct(kind.alias("kind"), line.alias("line"))


def level_of(kind: str, line: str) -> int:
    """0 is the top: by the signs of a marked header, the dots of a numbered one; sections stand below chapters."""
    if kind == "markdown":
        return len(line) - len(line.lstrip("#")) - 1
    if kind == "numbered":
        return re.match(r"(\d+\.)+", line)[0].count(".") - 1
    return int(kind == "chapter" and not line.startswith(("Chapter", "Bölüm")))


def pieces_of(section: Column, budget: int) -> Column:
    """What a section is packed from: itself if it fits, else its paragraphs; those beyond the budget give their sentences, those with
    three numbered steps stay whole. Each piece has its text, how (whole, paragraph, sentence, steps) and the number of its paragraph."""

    def piece(text: Column, how: str, n: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(how).alias("how"), n.cast("int").alias("n"))

    def paragraph(p: Column, n: Column) -> Column:
        sentences = F.transform(F.split(p, r"(?<=[.?!])\s+"), lambda s: piece(s, "sentence", n))
        steps = F.regexp_count(p, F.lit(r"(?m)^\s*\d+[.)]\s+")) >= 3
        return F.when(steps, F.array(piece(p, "steps", n))).when(_tokens(p) > budget, sentences).otherwise(F.array(piece(p, "paragraph", n)))

    return F.when(_tokens(section) <= budget, F.array(piece(section, "whole", F.lit(0)))).otherwise(F.flatten(F.transform(F.split(section, r"\n\n+"), paragraph)))


def packed(pieces: Iterable, budget: int, overlap: int) -> Iterator[str]:
    """Chunks of pieces (text, how, n) in order, filled up to the budget of estimated tokens.

    Paragraphs are joined by blank lines, sentences of one paragraph by spaces. Steps and whole sections stand alone; a sentence beyond
    the budget is cut into word windows.
    """
    held: list[str] = []
    filled, bond = 0, None
    for text, how, n in ((p["text"], p["how"], p["n"]) for p in pieces):
        alone, size = how in ("whole", "steps"), len(text) // 4
        wide = how == "sentence" and size > budget
        now = ("\n\n", -1) if how == "paragraph" else (" ", n)
        if held and (alone or wide or now != bond or filled + size > budget):
            yield bond[0].join(held)
            held, filled = [], 0
        if alone:
            yield text
        elif wide:
            yield from word_windows(text, budget, overlap)
        else:
            held.append(text)
            filled, bond = filled + size, now
    if held:
        yield bond[0].join(held)


def merged(chunks: Iterable[dict], least: int) -> list[dict]:
    """Chunks in order, one below ``least`` estimated tokens taking in the next; the first one's section is the whole's."""
    done: list[dict] = []
    for chunk in chunks:
        if done and len(done[-1]["chunk"]) // 4 < least:
            done[-1] = done[-1] | {"chunk": done[-1]["chunk"] + "\n\n" + chunk["chunk"]}
        else:
            done.append(chunk)
    return done


def paths(heads: Iterable) -> list[str | None]:
    """For each header in order the names (50 characters) above it and its own; a level that was skipped does not count."""
    above: list[str] = []
    found = []
    for h in heads:
        if h["kind"] != "body":
            above = [*above[: level_of(h["kind"], h["line"])], re.sub(r"^#+\s*", "", h["line"])[:50]]
        found.append(" > ".join(above) or None)
    return found


def semantic_chunks(docs: DataFrame, budget: int = 1000, least: int = 100, overlap: int = 50, headers: dict[str, str] = HEADERS, key: str = "doc_id", text_col: str = "text", merge: bool = True) -> DataFrame:
    """(key, seq, section, kind, path, chunk, tokens): the sections of each text, cut where they exceed the budget, and merged where they
    fall below ``least``. Null and empty texts have no chunks."""

    def of(heads: list[dict] | None, parts: list[list[dict]] | None) -> list[tuple]:
        own = zip(heads or [], paths(heads or []), parts or [], strict=True)
        cut = ({"section": i, "kind": h["kind"], "path": path, "chunk": c} for i, (h, path, p) in enumerate(own) for c in packed(p, budget, overlap))
        return [tuple(c.values()) for c in (merged(cut, least) if merge else cut)]

    rows = docs.select(key, section_texts(cleaned(F.col(text_col)), headers).alias("s"))
    given = rows.select(key, F.transform("s", lambda s: header_of(s, headers)).alias("heads"), F.transform("s", lambda s: pieces_of(s, budget)).alias("pieces"))
    return _unfolded(given, of, "seq", "section int, kind string, path string, chunk string").withColumn("tokens", _tokens(F.col("chunk")))


def larger_stay(spans: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans (first, last, kind) without those that overlap a larger one that stays; of equal ones the earlier. In order."""
    kept: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(spans, key=lambda s: (s[0] - s[1], s)):
        if all(b < x or y < a for x, y, _ in kept):
            kept.append((a, b, kind))
    return sorted(kept)


def regions(lines: list[str], kinds: dict[str, tuple[str, int, int, int]] = REGIONS) -> list[tuple[str, list[str]]]:
    """A text's lines as (kind, lines) in order: unbroken runs of each kind that are long enough, the larger of two that overlap,
    and prose between them. Every line is in one region."""
    spans = []
    for kind, (pattern, few, chars, _) in kinds.items():
        fits = [*(bool(re.search(pattern, line)) for line in lines), False]
        begin = None
        for i, fit in enumerate(fits):
            if fit and begin is None:
                begin = i
            elif not fit and begin is not None:
                if i - begin >= few and len("\n".join(lines[begin:i]).strip()) >= chars:
                    spans.append((begin, i - 1, kind))
                begin = None
    found, at = [], 0
    for a, b, kind in larger_stay(spans):
        found += [("prose", lines[at:a])] * (a > at) + [(kind, lines[a : b + 1])]
        at = b + 1
    return found + [("prose", lines[at:])] * (at < len(lines))


def region_segments(docs: DataFrame, kinds: dict[str, tuple[str, int, int, int]] = REGIONS, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, segment, kind, lines): the regions of each text."""

    return _unfolded(docs.select(key, F.split(cleaned(F.col(text_col)), "\n").alias("lines")), lambda lines: regions(lines, kinds), "segment", "kind string, lines array<string>")


def row_groups(lines: Column, kind: Column, kinds: dict[str, tuple[str, int, int, int]] = REGIONS) -> Column:
    """The chunks of a region that is no prose: so many lines each. Those of a table stand under its header: its first line, and the
    second where that only rules it off."""
    ruled = F.coalesce(F.try_element_at(lines, F.lit(2)).rlike(r"^[|\s:+-]+$"), F.lit(False))
    head = F.when(kind == "table", F.when(ruled, 2).otherwise(1)).otherwise(0)
    per = F.coalesce(*[F.when(kind == k, F.lit(n)) for k, (_, _, _, n) in kinds.items()], F.lit(5))
    groups = F.greatest(F.ceil((F.size(lines) - head) / per), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.array_join(F.concat(F.slice(lines, F.lit(1), head), F.slice(lines, head + g * per + 1, per)), "\n"))


def hybrid_chunks(docs: DataFrame, budget: int = 1000, least: int = 100, overlap: int = 50, kinds: dict[str, tuple[str, int, int, int]] = REGIONS, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, seq, kind, chunk, tokens): each region of a text cut by its own chunker (prose by semantic_chunks, the others by rows), then
    merged in order where chunks fall below ``least``; a merged chunk has the kind of its first.

    Only the chunks of a document meet in one row for the last step. Null and empty texts have no chunks.
    """
    parts = stored(region_segments(docs, kinds, key, text_col), "regions")  # read twice
    named = parts.select(F.struct(key, "segment").alias("at"), "kind", F.array_join("lines", "\n").alias("text"), "lines")
    prose = semantic_chunks(named.filter("kind = 'prose'"), budget, least, overlap, key="at").select("at", F.col("seq").alias("part"), F.lit("prose").alias("kind"), "chunk")
    rows = named.filter("kind <> 'prose'").select("at", "kind", F.posexplode(row_groups(F.col("lines"), F.col("kind"), kinds)).alias("part", "chunk")).select("at", "part", "kind", "chunk")

    def together(chunks: list[dict]) -> list[tuple]:
        return [(c["kind"], c["chunk"]) for c in merged(chunks, least)]

    every = prose.unionByName(rows).groupBy(F.col(f"at.{key}").alias(key)).agg(F.sort_array(F.collect_list(F.struct(F.col("at.segment").alias("segment"), "part", "kind", "chunk"))).alias("l"))
    return _unfolded(every, together, "seq", "kind string, chunk string").withColumn("tokens", _tokens(F.col("chunk")))
