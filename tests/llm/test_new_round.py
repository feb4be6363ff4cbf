"""Mixing, fill-in-the-middle and whitening against plain versions on small tables with awkward rows."""

import hashlib
import heapq
import math
import random
import re
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandline.llm import fill_in_middle, mixing, queries, whitening

SF = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, source string, size long, taken long, key string, part long, form string, n long, h long"


def documents(spark, rows):
    """Rows of (id, text, source) with extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, s, 5, 6, "k", 7, "f", 8, 9) for i, t, s in rows], SCHEMA)


# --- mixing


def plain_targets(sizes, weights, share, most):
    """Goal by weight; the excess of those above is reshared among the others, source by source."""
    got = dict.fromkeys(sizes, 0.0)
    left, active = share * sum(sizes.values()), set(sizes)
    while active and left > 1e-9:
        total = sum(weights[s] for s in active)
        for s in active:
            got[s] += left * weights[s] / total
        left = 0.0
        for s in list(active):
            if got[s] >= most * sizes[s]:
                left += got[s] - most * sizes[s]
                got[s] = float(most * sizes[s])
                active.discard(s)
    return got


def plain_seats(votes, caps, seats):
    """Seat after seat to the highest quotient."""
    given, heap = dict.fromkeys(votes, 0), [(-v, s) for s, v in votes.items() if v > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, s = heapq.heappop(heap)
        if given[s] < caps[s]:
            given[s] += 1
            seats -= 1
            heapq.heappush(heap, (-votes[s] / (2 * given[s] + 1), s))
    return given


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def mixture(spark, seed, n, block, shard_docs=7):
    r = random.Random(seed)
    rows = [(i, r.choice([None, "", " \t\n", "a", " ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(0, 90)))]), r.choice(["hot"] * 6 + ["b", "ä", "", None, "z", "\U0001f600", "￿"])) for i in range(n)]
    rows += [(n, "tail " * 4000, "z"), (n + 1, "one", "single"), (n + 2, "", "nothing")]
    return rows, mixing.mixed_sources(documents(spark, rows), block_words=block, shard_docs=shard_docs, shard_words=900)


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 240, 16), (2, 60, 1), (3, 150, 50)])
def test_mix_equals_the_plain_method(spark, seed, n, block):
    rows, mixed = mixture(spark, seed, n, block)
    got = {x.doc_id: x for x in mixed.collect()}
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += words(t)
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    targets = plain_targets(sizes, weights, 1.5, 2)
    for i, t, s in rows:
        x = got[i]
        assert (x.source, x.size, x.source_size) == (s, words(t), sizes[s]) and 0 <= x.taken <= 2 * x.size
        assert x.target == pytest.approx(targets[s], rel=1e-9, abs=1e-6)
    quota = plain_seats({k: targets[s] for k, s in enumerate(order)}, {k: 2 * -(-sizes[s] // block) for k, s in enumerate(order)}, int(sum(targets.values()) / block + 0.5))
    for k, s in enumerate(order):
        mine = [got[i] for i, _, x in rows if x == s]
        taken, shards = sum(x.taken for x in mine), max(1, math.ceil(len(mine) / 7), math.ceil(sizes[s] / 900))
        assert abs(taken - quota[k] * block) <= 2 * block * shards  # the last block of a shard is shorter
        assert abs(quota[k] * block - targets[s]) <= block


def test_apportionment_equals_the_heap(spark):
    r = random.Random(9)
    rows = []
    for key, n, seats in (("a", 40, 1000), ("b", 1, 7), ("c", 30, 3), ("d", 12, 500), ("e", 5, 0), ("f", 4, 10)):
        for p in range(n):
            v = float(r.choice([0, 5, 5, 60, r.randrange(1, 400)])) if key != "f" else 0.0
            rows.append((key, p, v, r.choice([2, 1000]) if key == "d" else 1000, seats))
    got = {(x.key, x.part): x.quota for x in mixing.apportioned(spark.createDataFrame(rows, "key string, part int, votes double, cap long, seats long")).collect()}
    for key in "abcdef":
        mine = [x for x in rows if x[0] == key]
        assert {p: got[key, p] for _, p, *_ in mine} == plain_seats({p: v for _, p, v, *_ in mine}, {p: c for _, p, _, c, _ in mine}, mine[0][4])


def test_blocks_are_taken_evenly_and_by_hash():
    copies = mixing.block_copies(10, 13, 5)
    assert sorted(copies.tolist()) == [1] * 7 + [2] * 3 and mixing.block_copies(10, 13, 5).tolist() == copies.tolist()
    assert any(mixing.block_copies(10, 13, s).tolist() != copies.tolist() for s in range(5))
    stream = np.repeat(np.arange(6), [3, 0, 11, 1, 20, 2])
    plain = np.bincount(stream, weights=np.repeat(mixing.block_copies(10, 13, 5), 4)[: len(stream)], minlength=6)
    assert mixing.words_taken(np.array([3, 0, 11, 1, 20, 2]), mixing.block_copies(10, 13, 5), 4).tolist() == plain.tolist()


def test_mix_does_not_depend_on_partitions_and_counts_repeated_ids(spark):
    rows = [(None if i % 3 == 0 else 5, "a b c d e f g " * (i % 9), "s") for i in range(50)] + [(1, "x y", None)]
    once = mixing.mixed_sources(documents(spark, rows))
    again = mixing.mixed_sources(documents(spark, rows).repartition(7))
    key = lambda df: sorted(((x.doc_id, x.size, x.taken, x.target) for x in df.collect()), key=str)
    assert key(once) == key(again) and once.count() == len(rows)
    assert mixing.mixed_sources(documents(spark, rows).limit(0)).count() == 0
    only_empty = mixing.mixed_sources(documents(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(x.size, x.target, x.taken) for x in only_empty] == [(0, 0.0, 0)] * 2


# --- fill in the middle


@given(st.lists(st.integers(0, 100_000), min_size=0, max_size=300), st.sampled_from([0, 1, 64]))
def test_rank_index_returns_every_offset(steps, error):
    offsets = np.cumsum([0, *steps]).astype(np.int64)
    index = fill_in_middle.RankIndex(offsets, error)
    assert index.offsets(np.arange(len(offsets))).tolist() == offsets.tolist()
    assert np.abs(index.residuals).max() <= error + 1


def test_rank_index_of_long_texts_has_few_segments():
    offsets = np.cumsum(np.random.default_rng(2).integers(55, 65, 40_000))
    assert len(fill_in_middle.RankIndex(offsets, 64).starts) < 400


def plain_cut(doc_id, text, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    form = "spm" if h4 % 100 < spm else "psm"
    return len(lines), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_fill_in_middle_equals_the_plain_cut(spark, rate, spm):
    r = random.Random(4)
    pieces = ["\n", "\n\n", "a", "é", "中文", "\U0001f600", "\r", " ", "<", "<S", "P>", "\x0b", " ", "\x00", "é"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(0, 60))) for _ in range(200)]
    texts += [None, "", "\n", "no end", "x<P>y\nz\n", "<M>", "<S\n>", "<\n", "long é line\n" * 30_000, "one" * 50_000]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "a\nb\nc\n", "s"), (3, "a\nb\n", "s"), (3, "a\nb\n", "s")]
    made = fill_in_middle.fill_in_middle(documents(spark, rows), rate, spm)
    made = made.withColumn("back", fill_in_middle.restored(made.output, made.form))
    got = sorted((tuple(x) for x in made.collect()), key=str)
    assert got == sorted(((i, *plain_cut(i, t, rate, spm), t or "") for i, t, _ in rows), key=str)
    assert fill_in_middle.fill_in_middle(documents(spark, rows).limit(0)).count() == 0


def test_fill_in_middle_keeps_ids_of_any_type(spark):
    docs = spark.createDataFrame([("id-1", "a\nb\nc\n")], "doc_id string, text string")
    row = fill_in_middle.fill_in_middle(docs).first()
    assert (row.doc_id, row.output) == ("id-1", plain_cut("id-1", "a\nb\nc\n")[-1])


# --- whitening


@pytest.mark.parametrize("kind", ["random", "equal", "graded", "blocks", "low rank", "tiny", "one"])
def test_components_equal_the_library(kind):
    rng = np.random.default_rng(5)
    n = {"one": 1}.get(kind, 40)
    a = rng.normal(size=(n, n))
    a = {
        "random": a @ a.T, "equal": np.eye(n) * 3, "graded": np.diag(2.0 ** -np.arange(n)), "low rank": np.outer(a[0], a[0]) * 1e6,
        "blocks": np.kron(np.diag([5.0, 5.0, 5.0, 5.0, 1.0]), np.full((8, 8), 1.0) + np.eye(8)), "tiny": a @ a.T * 1e-200, "one": np.ones((1, 1)) * 7,
    }[kind]
    values, vectors = whitening.leading_components(a, 4)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:4]
    norm = np.abs(want).max()
    assert np.abs(values - want).max() <= 1e-12 * norm
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() <= 1e-12
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * norm


def embeddings(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, [1]) for i, v in vectors], "vec_id long, embedding array<float>, n long, component int, x array<int>")


def test_whitening_equals_the_plain_one(spark):
    rng = np.random.default_rng(6)
    base = (rng.normal(size=(300, 9)) * np.linspace(0.1, 2, 9) + 0.3).astype(np.float32)
    vectors = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(200)] + [(7, base[1].tolist()), (None, base[2].tolist())]
    nan, inf = float("nan"), float("inf")
    odd = [(2000, None), (2001, [nan] * 9), (2002, [inf] + [0.0] * 8), (2003, [None] + [0.0] * 8), (2004, []), (2005, [1.0, 2.0]), (2006, [3e38] * 9), (2007, [-0.0] * 9)]
    got = whitening.whiten(embeddings(spark, vectors + odd)).collect()
    kept = vectors + [odd[-1]]
    x = np.array([np.floor(256 * np.asarray(v, float)) for _, v in kept]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    cov = centred.T @ centred / n
    values, columns = np.linalg.eigh(cov)
    values, columns = values[::-1][:4], columns[:, ::-1][:, :4]
    want = (x - sums / n) @ columns / np.sqrt(values)
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10
    deviations = {tuple(v): int(((n * v.astype(object) - sums) ** 2).sum()) for v in x}
    by = defaultdict(list)
    for r in got:
        by[r.vec_id, r.component].append(r)
    signs = [np.sign(by[0, k + 1][0].whitened * want[0, k]) for k in range(4)]
    seen = defaultdict(list)
    for (i, _), v, w in zip(kept, x, want, strict=True):
        seen[i].append((deviations[tuple(v)], w))
    for i, rows in seen.items():
        for k in range(4):
            mine = sorted((r.deviation, r.whitened) for r in by[i, k + 1])
            for (d, w), (deviation, white) in zip(mine, sorted((d, signs[k] * w[k]) for d, w in rows), strict=True):
                assert d == deviation and w == pytest.approx(white, abs=1e-9)
            assert by[i, k + 1][0].explained == pytest.approx(values[k] / np.trace(cov), rel=1e-10)


def test_whitening_of_tables_without_variance(spark):
    assert whitening.whiten(embeddings(spark, [])).count() == 0
    assert whitening.whiten(embeddings(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whiten(embeddings(spark, [(i, [i / 8, i / 4]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1} and len(line) == 9 and line[0].explained == pytest.approx(1)


def test_deviations_are_exact_or_null():
    model = whitening.Whitening(3, (10, -7), np.zeros((2, 0)), np.zeros(0), np.zeros(0))
    assert model.deviations(np.array([[5, 1], [1 << 40, 0], [1 << 29, 1 << 20]])) == [25 + 100, None, (3 * (1 << 29) - 10) ** 2 + (3 * (1 << 20) + 7) ** 2]


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_registered_queries_over_whole_tables(spark):
    mix = queries.op11_source_mixing(spark, str(SF)).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in mix) == sorted(docs)
    taken, target = defaultdict(int), {}
    for r in mix:
        assert r.size == words(docs[r.doc_id].text) and r.taken <= 2 * r.size
        taken[docs[r.doc_id].source] += r.taken
        target[docs[r.doc_id].source] = r.target
    assert all(abs(taken[s] - target[s]) <= 40 for s in taken)
    for r in queries.op12_fill_in_middle(spark, str(SF)).collect():
        n, form, prefix, middle, output = plain_cut(r.doc_id, docs[r.doc_id].text)
        sha = hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((docs[r.doc_id].text or "").encode()).hexdigest()
        assert tuple(r) == (r.doc_id, n, form, prefix, middle, *sha)
    white = queries.op13_whitening(spark, str(SF)).collect()
    assert len(white) == 4 * spark.read.parquet(f"{SF}/embeddings.parquet").count() and white[0].identity_error < 1e-9
