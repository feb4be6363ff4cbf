"""Quality scores by co-training two views of a document.

One classifier sees the text's content (hashed words and a few ratios), the other what is known about the page without
reading it (source, language, length). Both start from the labelled documents. In each round either one
scores all unlabelled documents and labels those it is surest of, in the classes' own proportion, for the other to learn from. At the end each view is
calibrated on labelled documents that neither learnt from, and a small logistic model weighs the two.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows
from .shared import dropped, written
from .toxicity import held_out, lowest_hashes

#: Labelled documents whose features a fit gathers at most. Of the unlabelled the driver gathers those that a view labels: the
#: features of at most 2 * ROUNDS * CONFIDENT. A document's features are TEXT_BUCKETS numbers at most, a few hundred mostly.
FIT_LABELLED = 3000
ROUNDS, CONFIDENT = 4, 150
TEXT_BUCKETS, PAGE_BUCKETS = 1 << 14, 1 << 10
THRESHOLD = 0.5

Row = tuple[str, str, str, int]  # text, lang, source, n_chars
Features = tuple[np.ndarray, np.ndarray]  # buckets and their values

RATIOS = [re.compile(p) for p in (r"[^\W\d_]", r"\d", r"[^\w\s]", r"\n", r"[A-Z]", r"https?://|@")]


def text_features(row: Row) -> Features:
    """Hashed words, their square root weighted and normed, and ratios of characters and of repeated words and lines."""
    text = row[0]
    words = text.lower().split()
    counts: dict[int, float] = {}
    for w in words:
        b = zlib.crc32(w.encode("utf-8", "surrogatepass")) % (TEXT_BUCKETS - 32)
        counts[b] = counts.get(b, 0) + 1
    n, lines = max(1, len(text)), text.split("\n")
    ratios = [len(p.findall(text)) / n for p in RATIOS]
    ratios += [len(set(words)) / max(1, len(words)), len(set(lines)) / len(lines), np.log1p(len(words)) / 10, sum(map(len, words)) / max(1, len(words)) / 10, 1.0]
    values = np.sqrt(np.fromiter(counts.values(), float, len(counts)))
    values = values / max(1e-9, float(np.sqrt((values**2).sum())))
    return np.concatenate((np.fromiter(counts, np.int64, len(counts)), TEXT_BUCKETS - 32 + np.arange(len(ratios)))), np.concatenate((values, ratios))


def page_features(row: Row) -> Features:
    """What stands beside the text: source, language and the magnitude of the length, alone and together."""
    _, lang, source, chars = row
    size = str(int(np.log2(max(1, chars))))
    names = [f"s:{source}", f"l:{lang}", f"n:{size}", f"sl:{source}:{lang}", f"ln:{lang}:{size}", "one"]
    return np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % PAGE_BUCKETS for x in names], np.int64), np.ones(len(names))


class Stack:
    """Features of many rows end to end."""

    def __init__(self, found: Iterable[Features]):
        found = list(found)
        sizes = [len(b) for b, _ in found]
        self.bucket = np.concatenate([b for b, _ in found]) if found else np.zeros(0, np.int64)
        self.value = np.concatenate([v for _, v in found]) if found else np.zeros(0)
        self.row, self.n = np.repeat(np.arange(len(found)), sizes), len(found)

    def logits(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weight[self.bucket] * self.value, self.n)


def logistic(stack: Stack, y: np.ndarray, size: int, steps: int = 150, rate: float = 0.3, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression by gradient steps with adaptive rates; y may be in between 0 and 1."""
    w, seen = np.zeros(size), np.full(size, 1e-8)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(stack.logits(w), -30, 30)))
        g = np.bincount(stack.bucket, ((p - y) / max(1, stack.n))[stack.row] * stack.value, size) + ridge * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    return w


@dataclass
class CoTrained:
    text: np.ndarray
    page: np.ndarray
    calibration: list[tuple[float, float]] = field(default_factory=lambda: [(1.0, 0.0), (1.0, 0.0)])
    weights: tuple[float, float, float] = (0.5, 0.5, 0.0)

    def combined(self, views: list[np.ndarray]) -> np.ndarray:
        """Columns: both views' scores and the combined one, from the views' logits."""
        z = [a * v + b for v, (a, b) in zip(views, self.calibration, strict=True)]
        z.append(self.weights[0] * z[0] + self.weights[1] * z[1] + self.weights[2])
        return np.stack([1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in z], axis=1)


def _row(r) -> Row:
    return r[0] or "", r[1] or "", r[2] or "", r[3] if r[3] is not None else len(r[0] or "")


def _dense(*columns: np.ndarray) -> Stack:
    width = len(columns) + 1
    return Stack((np.arange(width), np.array([*values, 1.0])) for values in zip(*columns, strict=True))


def features(docs: DataFrame) -> DataFrame:
    """key, doc_id, bucket, value, page: both views' features of each row; key is a hash of the row."""
    cols = ["text", "lang", "source", "n_chars"]

    def make():
        def run(given: Iterator[tuple]) -> Iterator[tuple]:
            for key, doc, *row in given:
                (bucket, value), (page, _) = text_features(_row(row)), page_features(_row(row))
                yield key, doc, bucket.astype(np.int32), value.astype(np.float32), page.astype(np.int32)

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(F.xxhash64("doc_id", *cols).alias("key"), "doc_id", *cols)
    return map_rows(keyed, make, f"key long, doc_id {kind}, bucket array<int>, value array<float>, page array<int>")


def _logits(batch: pa.RecordBatch, weights: list[np.ndarray]) -> list[np.ndarray]:
    """Both views' logits of a batch of bucket, value, page."""
    found = []
    for v, bucket in enumerate((batch.column("bucket"), batch.column("page"))):
        bounds = bucket.offsets.to_numpy()
        flat = slice(int(bounds[0]), int(bounds[-1]))
        part = weights[v][bucket.values.to_numpy()[flat]]
        if v == 0:
            part = part * batch.column("value").values.to_numpy()[flat]
        found.append(np.bincount(np.repeat(np.arange(batch.num_rows), np.diff(bounds)), part, batch.num_rows))
    return found


class Unlabelled:
    """The documents without labels, scored anew in each round from a table of all documents' features."""

    def __init__(self, docs: DataFrame, marked: DataFrame):
        self._set(written(features(docs), "features"), marked)

    @classmethod
    def among(cls, found: DataFrame, marked: DataFrame) -> Unlabelled:
        """From a table that features() made."""
        self = cls.__new__(cls)
        self._set(found, marked)
        return self

    def _set(self, found: DataFrame, marked: DataFrame) -> None:
        self.found, self.marked = found, marked.select("doc_id").distinct()

    @property
    def rows(self) -> DataFrame:
        return self.found.join(self.marked.hint("merge"), "doc_id", "left_anti")

    def surest(self, weights: list[np.ndarray], taken: list[set[int]], low: int, high: int) -> list[tuple[list[int], list[int]]]:
        """For each view the keys of the low documents that it scores lowest and of the high ones that it scores highest, but
        those taken from it. All are scored; only ids, keys and scores move, and each top-k is cut in the tasks first."""
        shared = self.found.sparkSession.sparkContext.broadcast(weights)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *map(pa.array, _logits(batch, shared.value))], names=["doc_id", "key", "z0", "z1"])

        kind = self.found.schema["doc_id"].dataType.simpleString()
        scored = self.found.mapInArrow(apply, f"doc_id {kind}, key long, z0 double, z1 double")
        free = written(scored.join(self.marked.hint("merge"), "doc_id", "left_anti").select("key", "z0", "z1"), "scores")

        def best(v: int, order: list, n: int) -> list[int]:
            return [r.key for r in free.filter(~F.col("key").isin(sorted(taken[v]))).orderBy(*order, "key").limit(n).collect()]

        ends = [(best(v, [F.col(f"z{v}")], low), best(v, [F.desc(f"z{v}")], high)) for v in (0, 1)]
        dropped(free)
        return ends

    def features(self, keys: set[int]) -> dict[int, list[Features]]:
        """Both views' features of the documents with these keys."""
        rows = self.found.filter(F.col("key").isin(sorted(keys))).dropDuplicates(["key"]).collect() if keys else []
        return {r.key: _both(r) for r in rows}


def _both(r) -> list[Features]:
    return [(np.array(r.bucket, np.int64), np.array(r.value)), (np.array(r.page, np.int64), np.ones(len(r.page)))]


def co_train(labelled: list[tuple[list[Features], int]], pool: Unlabelled, rounds: int = ROUNDS, confident: int = CONFIDENT) -> CoTrained:
    """Fit on three quarters of the labelled rows (both views' features, and the label) and the pool, calibrate on the last quarter."""
    learn = [x for i, x in enumerate(labelled) if i % 4 != 3]
    rest = [x for i, x in enumerate(labelled) if i % 4 == 3]
    y = np.array([q for _, q in learn], float)
    if not len(y) or y.min() == y.max():
        level = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return CoTrained(np.zeros(TEXT_BUCKETS), np.zeros(PAGE_BUCKETS), weights=(0.0, 0.0, float(np.log(level / (1 - level)))))
    sizes = [TEXT_BUCKETS, PAGE_BUCKETS]
    own = [[r[v] for r, _ in learn] for v in (0, 1)]
    pooled: dict[int, list[Features]] = {}
    given: list[dict[int, float]] = [{}, {}]  # pseudo-labels of the pool, by the view that learns from them
    weights = [np.zeros(size) for size in sizes]
    for turn in range(rounds + 1):
        for v, size in enumerate(sizes):
            extra = sorted(given[v])
            weights[v] = logistic(Stack([*own[v], *[pooled[i][v] for i in extra]]), np.concatenate((y, [given[v][i] for i in extra])), size)
        if turn == rounds:
            break
        good = round(confident * y.mean())
        taken = [set(given[1 - v]) for v in (0, 1)]
        found = pool.surest(weights, taken, confident - good, good)
        pooled |= pool.features({i for ends in found for keys in ends for i in keys} - set(pooled))
        for v, (low, high) in enumerate(found):
            given[1 - v].update(dict.fromkeys(low, 0.0) | dict.fromkeys(high, 1.0))
    model = CoTrained(*weights)
    if rest and 0 < (t := np.array([q for _, q in rest], float)).mean() < 1:
        z = [Stack([r[v] for r, _ in rest]).logits(weights[v]) for v in (0, 1)]
        model.calibration = [tuple(logistic(_dense(x), t, 2, steps=300).tolist()) for x in z]
        both = [a * x + b for x, (a, b) in zip(z, model.calibration, strict=True)]
        model.weights = tuple(logistic(_dense(*both), t, 3, steps=300).tolist())
    return model


def _row(r) -> Row:
    return r[0] or "", r[1] or "", r[2] or "", r[3] if r[3] is not None else len(r[0] or "")


def fit_features(found: DataFrame, labels: DataFrame, fit_labelled: int = FIT_LABELLED) -> CoTrained:
    """Co-train on a table that features() made: on at most fit_labelled documents whose ids hash lowest of those with labels that
    are not held out, and on all documents without labels."""
    marked = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = F.broadcast(lowest_hashes(marked.filter(~held_out(F.col("doc_id"))), fit_labelled))  # at most so many rows
    learn = found.join(known, "doc_id").orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id", "key").limit(fit_labelled).collect()
    return co_train([(_both(r), int(r.quality)) for r in learn], Unlabelled.among(found, marked))


def fit(docs: DataFrame, labels: DataFrame, fit_labelled: int = FIT_LABELLED) -> CoTrained:
    """fit_features() of the documents' features; texts of any length take part."""
    return fit_features(written(features(docs), "features"), labels, fit_labelled)


def score_features(found: DataFrame, model: CoTrained) -> DataFrame:
    """doc_id, text_score, page_score, score, predicted (1 from THRESHOLD on) of each row of a table that features() made."""
    kind = found.schema["doc_id"].dataType.simpleString()
    shared = found.sparkSession.sparkContext.broadcast(model)  # a number a bucket, whatever the input's size

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.combined(_logits(batch, [shared.value.text, shared.value.page]))
            predicted = (scores[:, 2] >= THRESHOLD).astype(np.int32)
            columns = [batch.column("doc_id"), *[pa.array(np.ascontiguousarray(scores[:, i])) for i in range(3)], pa.array(predicted)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_score", "page_score", "score", "predicted"])

    return found.mapInArrow(apply, f"doc_id {kind}, text_score double, page_score double, score double, predicted int")


def score(docs: DataFrame, model: CoTrained) -> DataFrame:
    """One row per row of docs: doc_id, text_score, page_score, score, predicted.

    docs has doc_id, text, lang, source and n_chars; nulls count as empty, a null n_chars as the text's length. Whole texts
    are read; repeated rows give repeated rows, an empty table none; other columns are not read.
    """
    return score_features(features(docs), model)
