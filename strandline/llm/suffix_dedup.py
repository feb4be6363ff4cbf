"""Repeated passages by a sampled, range-partitioned suffix array.

A byte goes when it lies in a string of ``width`` bytes that also starts earlier. Sorting every suffix of a corpus would
move each byte a hundred times, so the suffixes that can decide anything are found first, without loss:

1. Each window of ``width`` bytes picks one anchor within, the k-gram with the least hash. Equal windows pick the same
   one at the same place. Neighbouring windows mostly share their anchor; what they cover together is its context.
   Equal contexts hold equal windows, so the first of them stands for all, within a task and then in a shuffle by anchor.
2. Of an anchor's different contexts some windows may still be equal: where a passage begins or ends, or one was
   edited. These contexts' suffixes from the anchor on are range-partitioned by their leading bytes, with splitters that
   Spark samples. Equal leading bytes never straddle a border, so a bucket is complete; within, borders between the chunks
   that fit memory fall between different leads. A multikey quicksort orders the windows of a chunk, eight bytes at a
   time and only among those still equal; neighbours that stay equal are repeats.
3. An anchor with very many different contexts would fill a bucket. Its windows go on one by one instead, keyed by all their
   bytes, and equal ones are counted in Spark.

Equal contexts of step 1 are told by 128 bits of hashes (64 of the anchor, 64 of the context), steps 2 and 3 compare bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .arrow import at_rest, map_rows, slices
from .shared import keyed_join, ordered_rows, written

WIDTH, GRAM = 100, 40
#: Bytes of text that are hashed at once (about 100 bytes of memory each); anchors among which a task looks for equal contexts before it
#: sends them on, and anchors that it sends at once.
BLOCK_BYTES, TASK_ANCHORS, SENT_ANCHORS = 1 << 18, 500_000, 20_000
#: Bytes of a text longer than a block that are hashed at once.
PIECE_BYTES = 1 << 19
#: Windows that a bucket sorts at once, and contexts of an anchor from which its windows are range-partitioned one by one instead.
CHUNK_WINDOWS, CROWDED = 200_000, 4000
#: Bits of a place in a block: an anchor is chosen by the other bits of its hash, however long the block is.
PLACE_BITS = 24

BASE = np.uint64(0xC6A4A7935BD1E995)
U = np.uint64


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class Hashes:
    """Rolling hashes of byte strings by prefix sums modulo 2**64."""

    def __init__(self):
        self.letters = np.random.default_rng(91).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
        self.power, self.back = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, 2 * len(self.power))
            with np.errstate(over="ignore"):
                self.power = np.concatenate(([U(1)], np.cumprod(np.full(size, BASE))))
                self.back = np.concatenate(([U(1)], np.cumprod(np.full(size, U(_inverse(int(BASE)))))))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._reach(len(data) + 1)
        return np.concatenate(([U(0)], np.cumsum(self.letters[data] * self.power[: len(data)])))

    def of(self, prefix: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        h = (prefix[end] - prefix[start]) * self.back[start]
        h ^= h >> U(32)
        h *= U(0x9FB21C651E98DF25)
        return h ^ (h >> U(29))


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: Hashes, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the texts data[starts:ends]: first window, last window, anchor, hash of the anchor, hash of the context."""
    n = len(data)
    if n < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    prefix = hashes.prefix(data)
    grams = n - gram + 1
    h = hashes.of(prefix, slice(0, grams), slice(gram, n + 1))
    reach = width - gram + 1  # anchors to choose from
    least = ((h >> U(PLACE_BITS)) << U(PLACE_BITS)) | np.arange(grams, dtype=np.uint64)
    span = 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    at = (least & U((1 << PLACE_BITS) - 1)).astype(np.int64)  # of window i, for each i
    own = np.searchsorted(starts, np.arange(len(at)), side="right") - 1
    valid = np.flatnonzero((own >= 0) & (np.arange(len(at)) + width <= ends[np.maximum(own, 0)]))
    if not len(valid):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    change = np.flatnonzero((np.diff(at[valid]) != 0) | (np.diff(valid) != 1)) + 1
    first = valid[np.concatenate(([0], change))]
    last = valid[np.concatenate((change - 1, [len(valid) - 1]))]
    anchor = at[first]
    return first, last, anchor, h[anchor], hashes.of(prefix, first, last + width)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, documents, starts, ends) of about size bytes or one longer text."""
    docs, texts, total = [], [], 0
    for batch in slices(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
            docs.append(doc)
            texts.append(text or b"")
            total += len(texts[-1])
            if total >= size:
                yield _joined(docs, texts)
                docs, texts, total = [], [], 0
    if docs:
        yield _joined(docs, texts)


def _joined(docs: list[int], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(t) for t in texts])
    return np.frombuffer(b"".join(texts), np.uint8), np.array(docs, np.int64), np.concatenate(([0], ends[:-1])), ends


#: h, c: hashes of anchor and context; start, n: first window and number of windows; off: bytes from start to the anchor.
#: c is null where the windows are known to be repeats.
ANCHORS = "h long, c long, doc long, start long, n long, off long"


def anchors(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """ANCHORS rows for documents (doc, text); of equal contexts in a task only the first keeps its hashes."""
    schema = to_arrow_schema(StructType.fromDDL(ANCHORS))

    def batch(h, c, doc, start, n, off, gone) -> pa.RecordBatch:
        h = np.where(gone, (doc * 31 + start) * np.int64(0x9E3779B97F4A7C1 | 1), h.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.view(np.int64), mask=gone), *[pa.array(x.astype(np.int64)) for x in (doc, start, n, off)]], schema=schema)

    def settle(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, c, doc, start, n, off = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.lexsort((start, doc, c, h))
        h, c, doc, start, n, off = (x[order] for x in (h, c, doc, start, n, off))
        gone = np.concatenate(([False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])))
        g = np.flatnonzero(gone)
        g = g[np.lexsort((start[g], doc[g]))]
        if len(g):  # neighbouring repeats of a document as one row
            d, a, b = doc[g], start[g], start[g] + n[g]
            cut = np.concatenate(([True], (d[1:] != d[:-1]) | (a[1:] > b[:-1])))
            head = np.flatnonzero(cut)
            tail = np.concatenate((head[1:], [len(g)])) - 1
            d, a, size = d[head], a[head], b[tail] - a[head]
        else:
            d = a = size = np.zeros(0, np.int64)
        k = ~gone
        zero = np.zeros(len(d), np.int64)
        joined = [np.concatenate(x) for x in ((h[k], zero.view(np.uint64)), (c[k], zero.view(np.uint64)), (doc[k], d), (start[k], a), (n[k], size), (off[k], zero))]
        gone = np.concatenate((np.zeros(k.sum(), bool), np.ones(len(d), bool)))
        del h, c, doc, start, n, off, order
        for i in range(0, len(gone), SENT_ANCHORS):
            yield batch(*[x[i : i + SENT_ANCHORS] for x in (*joined, gone)])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, parts, total = Hashes(), [], 0
        with np.errstate(over="ignore"):
            for data, docs_, starts, ends in _blocks(batches, BLOCK_BYTES):
                long = ends - starts >= width
                starts, ends, docs_ = starts[long], ends[long], docs_[long]
                if not len(starts):
                    continue
                for at in range(0, len(data), PIECE_BYTES):  # one but for very long texts; each window begins in one piece
                    piece = data[at : at + PIECE_BYTES + width - 1]
                    first, last, anchor, h, c = contexts(piece, starts - at, ends - at, hashes, width, gram)
                    first, last, anchor = first + at, last + at, anchor + at
                    own = np.searchsorted(starts, first, side="right") - 1
                    parts.append((h, c, docs_[own], first - starts[own], last - first + 1, anchor - first))
                    total += len(first)
                    if total >= TASK_ANCHORS:
                        yield from settle(parts)
                        total = 0
            if parts:
                yield from settle(parts)

    return docs.mapInArrow(at_rest(apply), ANCHORS)


def multikey_groups(words: list[np.ndarray], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order rows by group and then by words, one word at a time among rows still equal: (rows, class) of the rows
    that have an equal, in order; equal rows share a class."""
    rows = np.arange(len(group))
    for word in [None, *words]:
        key = word[rows] if word is not None else None
        order = np.argsort(group, kind="stable") if key is None else np.lexsort((key, group))
        rows, group = rows[order], group[order]
        change = group[1:] != group[:-1]
        if key is not None:
            key = key[order]
            change |= key[1:] != key[:-1]
        group = np.concatenate(([0], np.cumsum(change))) if len(rows) else group
        many = np.bincount(group)[group] > 1 if len(rows) else np.zeros(0, bool)
        rows, group = rows[many], group[many]
    return rows, group


def repeats(text: list[bytes], doc: np.ndarray, start: np.ndarray, n: np.ndarray, off: np.ndarray, lead: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, window start) of the windows in the contexts that are equal to an earlier one. lead: number of the anchor."""
    sizes = np.array([len(t) for t in text])
    flat = np.frombuffer(b"".join(text) + b"\0" * 16, np.uint8).astype(np.uint64)
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    eight = np.zeros(len(flat) - 8, np.uint64)
    for i in range(8):
        eight = (eight << U(8)) | flat[i : len(flat) - 8 + i]
    which = np.repeat(np.arange(len(n)), n)
    shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos = at[which] + shift
    words = [eight[pos + i] >> U(8 * max(0, i + 8 - width)) for i in range(0, width, 8)]
    group = lead[which] * width + (off[which] - shift)  # equal windows hold their anchor at the same place
    rows, cls = multikey_groups(words, group)
    d, s = doc[which[rows]], start[which[rows]] + shift[rows]
    order = np.lexsort((s, d, cls))
    later = np.concatenate(([False], np.diff(cls[order]) == 0)) if len(order) else np.zeros(0, bool)
    return d[order][later], s[order][later]


def _compare(buckets: DataFrame, width: int) -> DataFrame:
    """doc, start, n of repeated windows; buckets: lead, ctx, doc, start, n, off, in the order of lead in each partition."""
    schema = "doc long, start long, n long"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> pa.RecordBatch:
            lead, ctx, doc, start, n, off = zip(*rows, strict=True)
            number = {x: i for i, x in enumerate(dict.fromkeys(lead))}
            arrays = [np.array(x, np.int64) for x in (doc, start, n, off)]
            ids = np.array([number[x] for x in lead], np.int64)
            d, s = repeats(list(ctx), *arrays, ids, width)
            order = np.lexsort((s, d))
            d, s = d[order], s[order]
            head = np.flatnonzero(np.concatenate(([True], (np.diff(d) != 0) | (np.diff(s) > 1)))) if len(d) else np.zeros(0, np.int64)
            tail = np.concatenate((head[1:], [len(d)])) - 1 if len(d) else head
            return pa.RecordBatch.from_arrays([pa.array(d[head]), pa.array(s[head]), pa.array(s[tail] - s[head] + 1)], schema=target)

        rows = (row for batch in slices(batches) for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        chunk, windows = [], 0
        for _, own in groupby(rows, key=lambda row: row[0]):
            own = list(own)
            size = sum(row[4] for row in own)
            if chunk and windows + size > CHUNK_WINDOWS:
                yield solve(chunk)
                chunk, windows = [], 0
            chunk += own
            windows += size
        if chunk:
            yield solve(chunk)

    return buckets.mapInArrow(at_rest(apply), schema)


def _equal_windows(windows: DataFrame) -> DataFrame:
    """doc, start, n of the windows (ctx, doc, start) whose bytes an earlier one has, however many are equal."""
    firsts = windows.groupBy("ctx").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = keyed_join(windows.select("ctx", "doc", "start"), written(firsts, "first-windows"), ["ctx"], "inner")
    return again.filter("doc <> first.doc OR start <> first.start").select("doc", "start", F.lit(1).cast("long").alias("n"))


def repeated_spans(keyed: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(doc, spans): the windows to remove in each document that has some, as (start, windows) structs."""
    w = Window.partitionBy("h").orderBy("c", "doc", "start")
    whole = Window.partitionBy("h")
    found = anchors(keyed.select("doc", "text"), width, gram)
    ranked = found.withColumn("repeat", F.col("c").isNull() | F.coalesce(F.lag("c").over(w) == F.col("c"), F.lit(False))).withColumn("mixed", F.min("c").over(whole) != F.max("c").over(whole)).withColumn("crowded", F.count("*").over(whole) > CROWDED)
    marked = written(ranked.filter("repeat OR mixed").select("doc", "start", "n", "off", "repeat", "crowded"), "marked-anchors")

    asked = marked.filter("NOT repeat").groupBy("doc").agg(F.collect_list(F.struct("start", "n", "off", "crowded")).alias("spans"))
    asked = written(asked, "open-contexts")

    def cut_out():
        def run(given: Iterator[tuple]) -> Iterator[tuple]:
            for doc, text, spans in given:
                for s in spans:
                    start, n, off = s["start"], s["n"], s["off"]
                    if s["crowded"]:
                        for at in range(start, start + n):
                            yield None, text[at : at + width], doc, at, 1, off - (at - start)
                    else:
                        yield text[start + off : start + off + gram], text[start : start + n - 1 + width], doc, start, n, off

        return run

    texts = keyed.select("doc", "text").join(asked.hint("merge"), "doc")
    suffixes = map_rows(texts.select("doc", "text", "spans"), cut_out, "lead binary, ctx binary, doc long, start long, n long, off long")
    suffixes = written(suffixes, "suffixes")  # read more than once: for the splitters and for the shuffles
    buckets = suffixes.filter("lead IS NOT NULL").repartitionByRange("lead").sortWithinPartitions("lead")
    equal = _compare(buckets, width).unionByName(_equal_windows(suffixes.filter("lead IS NULL")))
    gone = marked.filter("repeat").select("doc", "start", "n").unionByName(equal)
    return written(gone.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "repeated-spans")


def _runs(spans: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that the windows cover."""
    a = np.array([(s["start"], s["start"] + s["n"] - 1 + width) for s in spans], np.int64).reshape(-1, 2)
    a = a[np.argsort(a[:, 0], kind="stable")]
    ends = np.maximum.accumulate(a[:, 1])
    head = np.concatenate(([True], a[1:, 0] > ends[:-1]))
    return a[head, 0], ends[np.concatenate((np.flatnonzero(head)[1:] - 1, [len(a) - 1]))]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, texts: bool = True, carry: list[str] = ()) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, with texts the kept bytes, and the columns
    to carry along.

    A null text is empty and keeps nothing. Rows that share an id count as earlier and later in the order of a
    hash of their texts; null ids come last. Texts shorter than width lose nothing; an empty table gives no rows; other columns
    are not read.
    """
    keyed = ordered_rows(docs, id_col, text_col, carry).withColumn("text", F.encode("text", "UTF-8"))
    kind = keyed.schema["doc_id"].dataType.simpleString()
    spans = repeated_spans(keyed, width, gram)

    def make():
        def run(given: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text, found, *more in given:
                removed, runs, kept = 0, 0, text
                if found:
                    first, end = _runs(found, width)
                    runs, removed = len(first), int((end - first).sum())
                    borders = zip([0, *end.tolist()], [*first.tolist(), len(text)], strict=True)
                    kept = b"".join([text[a:b] for a, b in borders])
                yield (doc_id, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), *([kept] if texts else []), *more)

        return run

    joined = keyed.join(spans.hint("merge"), "doc", "left").select("doc_id", "text", "spans", *[f"_carry_{c}" for c in carry])
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return map_rows(joined, make, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts + kinds)
