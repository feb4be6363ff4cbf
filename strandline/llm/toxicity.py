"""Toxicity by averaged subword embeddings and a linear softmax, trained together in numpy.

A word's features are its hashed character n-grams with borders, so that a misspelling nobody has labelled still shares
vectors with the words that were. A bag is a run of words; its embedding is the mean of the vectors of its features, and
the softmax tells the toxic from the clean. Bags are short, for a few bad words in a long text must not be averaged
away: a text's score comes from its worst bag, calibrated on labelled texts that took no part in the training.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import at_rest, map_rows, slices
from .shared import dropped, written

#: Labelled ids that a fit uses at most, and toxic bags that it gathers at most (and three clean ones for each): runs of BAG
#: words, some 60 characters each, so that the driver holds tens of megabytes however long the texts are.
FIT_DOCS, FIT_BAGS = 4000, 60_000
BUCKETS, DIM, BAG = 1 << 16, 8, 8
GRAMS = (3, 4, 5)
THRESHOLD = 0.3
CACHE_WORDS, BLOCK_CHARS = 120_000, 1_000_000


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature of the words, in lower case and with borders."""
    shown = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(shown).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, shown), np.int64, len(shown))
    owner = np.repeat(np.arange(len(shown)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    found = []
    h = np.zeros(len(code), np.uint64)
    for n in range(1, max(GRAMS) + 1):  # h[i]: hash of the n characters from i
        h[: len(code) - n + 1] = h[: len(code) - n + 1] * np.uint64(1099511628211) + code[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(np.arange(len(code)) + n <= ends)
            mixed = (h[at] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            found.append((owner[at], (mixed >> np.uint64(48)).astype(np.int64) % BUCKETS))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


@dataclass
class Model:
    """share: what each bucket adds to a bag's logit; slope and level calibrate a text's worst bag."""

    share: np.ndarray
    bias: float
    slope: float = 1.0
    level: float = 0.0

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum, number) of the features' shares of each word."""
        owner, bucket = features(words)
        return np.bincount(owner, self.share[bucket], len(words)), np.bincount(owner, minlength=len(words)).astype(np.float64)

    def worst(self, sums: np.ndarray, counts: np.ndarray) -> float:
        """The largest logit of a text's bags; bags begin at every half bag, so that no neighbours are always cut apart."""
        n = len(sums)
        if not n:
            return self.bias
        half = np.arange(0, n, BAG // 2)
        s, c = np.add.reduceat(sums, half), np.add.reduceat(counts, half)
        if len(half) > 1:
            s, c = s[:-1] + s[1:], c[:-1] + c[1:]
        return float((s / c).max() + self.bias)

    def calibrated(self, logit: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * logit + self.level, -30, 30))))


class Scorer:
    """Scores texts with the shares of words remembered in bounded memory."""

    def __init__(self, model: Model):
        self.model, self.known, self.old = model, {}, {}

    def logits(self, texts: list[str]) -> list[float]:
        cut = [t.lower().split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known, self.old = {}, self.known
        new = []
        for w in set().union(*cut).difference(self.known):
            if w in self.old:
                self.known[w] = self.old[w]
            else:
                new.append(w)
        known = self.known
        if new:
            known.update(zip(new, zip(*[x.tolist() for x in self.model.word_scores(new)], strict=True), strict=True))
        out = []
        for words in cut:
            pairs = np.array(list(map(known.__getitem__, words))).reshape(-1, 2)
            out.append(self.model.worst(pairs[:, 0], pairs[:, 1]))
        for w in new:
            if len(w) > 40:
                del known[w]
        return out


def bags(text: str) -> list[str]:
    """The words of a text in runs of BAG, as they are trained on."""
    words = text.lower().split()
    return [" ".join(words[i : i + BAG]) for i in range(0, len(words), BAG)]


def train(bad: list[str], good: list[str], epochs: int = 4, rate: float = 0.5, clean_bags: int = 3, seed: int = 7) -> Model:
    """Joint training of subword vectors and softmax on bags of words, by minibatches with adaptive rates.

    All bags of toxic texts are used, and clean_bags times as many drawn from those of clean texts.
    """
    if not bad or not good:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    good = [good[i] for i in rng.permutation(len(good))[: clean_bags * len(bad)]]
    number: dict[str, int] = {}
    runs = [np.array([number.setdefault(w, len(number)) for w in b.split(" ")], np.int64) for b in bad + good]
    y = np.repeat(np.array([1, 0]), [len(bad), len(good)])
    words = list(number)
    owner, bucket = features(words)
    order = np.argsort(owner, kind="stable")
    bucket, size = bucket[order], np.bincount(owner, minlength=len(words))
    first = np.concatenate(([0], np.cumsum(size)))
    vectors, softmax, bias = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, 2)), np.zeros(2)
    seen_v, seen_s, seen_b = np.full(BUCKETS, 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    for _ in range(epochs):
        shuffled = rng.permutation(len(runs))
        for at in range(0, len(runs), 512):
            batch = shuffled[at : at + 512]
            ws = np.concatenate([runs[i] for i in batch])
            bag = np.repeat(np.arange(len(batch)), [len(runs[i]) for i in batch])
            n = size[ws]
            flat = bucket[np.repeat(first[ws] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            own = np.repeat(bag, n)
            total = np.bincount(own, minlength=len(batch))[:, None]
            mean = np.add.reduceat(vectors[flat], np.flatnonzero(np.diff(own, prepend=-1))) / total
            z = mean @ softmax + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            step = (p @ softmax.T) / total
            g = mean.T @ p / len(batch)
            touched, where = np.unique(flat, return_inverse=True)
            gv = np.stack([np.bincount(where, step[own, d], len(touched)) for d in range(DIM)], axis=1)
            seen_v[touched] += (gv * gv).mean(axis=1)
            vectors[touched] -= rate * gv / np.sqrt(seen_v[touched])[:, None]
            seen_s += g * g
            softmax -= rate * g / np.sqrt(seen_s)
            gb = p.mean(axis=0)
            seen_b += gb * gb
            bias -= rate * gb / np.sqrt(seen_b)
    weight = softmax[:, 1] - softmax[:, 0]
    return Model(vectors @ weight, float(bias[1] - bias[0]))


def _calibrate(logits: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """slope and level that put the cut with the most right decisions of either kind (F1) at a score of THRESHOLD."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + max(1, toxic.sum()))
    f1[np.flatnonzero(np.diff(logits[order]) == 0)] = -1  # no cut between equals
    best = int(np.argmax(f1))
    sorted_logits = logits[order]
    cut = (sorted_logits[best] + (sorted_logits[best + 1] if best + 1 < len(order) else sorted_logits[best] - 1)) / 2
    slope = 1 / max(1e-3, float(np.std(logits)))
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut)


def held_out(doc_id: Column) -> Column:
    """Ids whose labels no fit may see: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def lowest_hashes(marked: DataFrame, rows: int) -> DataFrame:
    """The rows of a label table (doc_id and a mark) whose ids hash lowest: a sample of at most so many narrow rows."""
    return marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit_labelled(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, fit_bags: int = FIT_BAGS) -> Model:
    """A model from the texts of at most fit_docs labelled ids, those that hash lowest and are not held out.

    Three quarters of the rows are trained on: tasks cut them into bags, of which the driver gathers at most fit_bags toxic and
    three times as many clean ones as toxic ones, by the order of a hash. The worst bags of the last quarter calibrate. Texts of any length take
    part; an id may stand for several rows. Without labels of both kinds every text gets the same score.
    """
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = F.broadcast(lowest_hashes(marked, fit_docs))  # at most so many rows
    rest = F.pmod(F.xxhash64("doc_id", "text"), F.lit(4)) == 3
    rows = docs.select("doc_id", "text").join(sample, "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"), rest.alias("rest"))
    rows = written(rows, "labelled-texts")  # those of the sample alone

    def cut():
        def run(given: Iterator[tuple]) -> Iterator[tuple]:
            for doc, text, toxic in given:
                for i, bag in enumerate(bags(text or "")):
                    yield toxic, zlib.crc32(f"{doc} {i} {bag}".encode("utf-8", "surrogatepass")), bag

        return run

    cuts = written(map_rows(rows.filter("NOT rest").select("doc_id", "text", "toxic"), cut, "toxic int, place long, bag string"), "bags")
    gathered = lambda toxic, n: [r.bag for r in cuts.filter(F.col("toxic") == toxic).orderBy("place", "bag").limit(n).collect()]
    bad = gathered(1, fit_bags)
    model = train(bad, gathered(0, 3 * len(bad)))
    kept = rows.filter("rest").select(F.xxhash64("doc_id", "text").alias("place"), "toxic", "text")
    worst = logits(kept, model, "place long, toxic int").orderBy("place", "logit").limit(fit_docs).collect()
    if worst:
        model.slope, model.level = _calibrate(np.array([r.logit for r in worst]), np.array([r.toxic for r in worst], np.int64))
    for old in (rows, cuts):
        dropped(old)
    return model


def logits(rows: DataFrame, model: Model, kept: str) -> DataFrame:
    """The columns before the last one (kept: their DDL), and logit, the worst bag's logit of the text in the last one."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # one number a bucket, whatever the input's size

    def make():
        scorer = Scorer(shared.value)

        def blocks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
            block, chars = [], 0
            for row in rows:
                block.append(row)
                chars += len(row[-1] or "")
                if chars >= BLOCK_CHARS:
                    yield block
                    block, chars = [], 0
            if block:
                yield block

        def run(given: Iterator[tuple]) -> Iterator[tuple]:
            for block in blocks(given):
                for row, logit in zip(block, scorer.logits([row[-1] or "" for row in block]), strict=True):
                    yield *row[:-1], logit

        return run

    return map_rows(rows, make, f"{kept}, logit double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1), predicted (1 from THRESHOLD on).

    Texts without a word (null ones too) get the score of an empty bag. Ids stay as they are, null ones too; other columns
    are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = logits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, f"doc_id {kind}")
    z = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col("logit") * model.slope + model.level))
    scored = found.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns; each row is judged by its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            found = scorer.logits([t or "" for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array([scorer.model.calibrated(z) < THRESHOLD for z in found], pa.bool_()))

    return docs.mapInArrow(at_rest(apply), docs.schema)
