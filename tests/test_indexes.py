"""Searches through the text and vector indexes against plain scoring of everything."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandline.operators import text_index, vector_index


def plain_bm25(docs, question, k):
    cut = {i: [w for w in (t or "").lower().split() if len(w) >= 3] for i, t in docs}
    df = Counter(w for ws in cut.values() for w in set(ws))
    average = sum(map(len, cut.values())) / len(cut)
    found = {}
    for i, ws in cut.items():
        tf = Counter(ws)
        score = sum(math.log((len(cut) - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ws) / average)) for w in question.split() if w in tf)
        if round(score, 6) > 0:
            found[i] = round(score, 6)
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))[:k]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    words = [f"word{i}" for i in range(200)]
    weights = [1 / (i + 1) for i in range(200)]
    docs = [(i, " ".join(r.choices(words, weights, k=r.randrange(1, 80)))) for i in range(1500)] + [(2000, None), (2001, ""), (2002, "word0 " * 500), (2003, "alone"), (2004, "alone")]
    asked = [(1, "word0 word1 word150"), (2, "word7 word7 word30 word0"), (3, "nothing known here"), (4, ""), (5, None), (6, "alone"), (7, " ".join(words))]
    return docs, asked


@pytest.mark.parametrize("k", [1, 10, 3000])
def test_text_search_equals_scoring_everything(spark, corpus, k):
    docs, asked = corpus
    index = text_index.build(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), name=f"test{k}")
    got = defaultdict(list)
    for r in sorted(text_index.search(index, spark.createDataFrame(asked, "query_id long, text string"), k).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.doc_id, r.score))
    for q, t in asked:
        want = plain_bm25(docs, t or "", k)
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want], abs=2e-6)


def test_postings_read_fall_with_k_and_the_index_is_made_once(spark, corpus):
    docs, asked = corpus
    table = spark.createDataFrame(docs, "doc_id long, text string")
    index, again = text_index.build(table, name="reads"), text_index.build(table.repartition(3), name="reads")
    assert again.lists.inputFiles() == index.lists.inputFiles()
    more = text_index.build(table.filter("doc_id < 1000"), name="reads")
    assert more.n == 1000 and more.lists.inputFiles() != index.lists.inputFiles()
    questions = spark.createDataFrame(asked[:2], "query_id long, text string")
    reads = {k: {r.query_id: (r.postings, r.read) for r in text_index.postings_read(index, questions, k).collect()} for k in (1, 20, 3000)}
    for q in (1, 2):
        every = reads[1][q][0]
        assert reads[1][q][1] < reads[20][q][1] <= reads[3000][q][1] == every
    assert sum(reads[1][q][1] for q in (1, 2)) < 0.5 * sum(reads[1][q][0] for q in (1, 2))


def test_lists_hold_each_posting_once_and_segments_are_bounded(spark, corpus, monkeypatch):
    monkeypatch.setattr(text_index, "POSTINGS", 700)
    index = text_index.build(spark.createDataFrame(corpus[0], "doc_id long, text string"), name="lists")
    seen, want, sizes = Counter(), Counter(), Counter()
    for b in index.lists.collect():
        assert b.docs == sorted(b.docs) and len(b.docs) == len(b.impacts)
        seen.update((b.term, d) for d in b.docs)
        sizes[b.segment] += len(b.docs)
    for i, t in corpus[0]:
        want.update({(w, i): 1 for w in set((t or "").split()) if len(w) >= 3})
    assert seen == want and len(sizes) > 20
    assert {t.term: t.df for t in index.terms.collect()} == Counter(w for w, _ in want)
    asked = spark.createDataFrame(corpus[1], "query_id long, text string")
    got = [(r.query_id, r.doc_id) for r in text_index.search(index, asked, 10).collect()]
    assert sorted(got) == sorted((q, i) for q, t in corpus[1] for i, _ in plain_bm25(corpus[0], t or "", 10))


@given(st.lists(st.tuples(st.floats(0.1, 5), st.dictionaries(st.integers(0, 30), st.floats(0.01, 2.5), min_size=1, max_size=31)), min_size=1, max_size=6), st.integers(1, 12))
def test_best_of_segment_equals_adding_everything(lists, k):
    given_ = [(f, np.array(sorted(d)), np.array([d[i] for i in sorted(d)])) for f, d in lists]
    places, found, read = text_index.best_of_segment(given_, 31, k)
    total = defaultdict(float)
    for f, d in lists:
        for i, x in d.items():
            total[i] += f * x
    # scores that differ by less than a rounding step may stand in either order
    want = sorted((round(s, 6) for s in total.values() if round(s, 6) > 0), reverse=True)[:k]
    assert found.tolist() == pytest.approx(want, abs=2e-6)
    assert [total[i] for i in places.tolist()] == pytest.approx(found.tolist(), abs=2e-6)
    assert 0 < read <= sum(len(p) for _, p, _ in given_)


# --- vectors


def plain_nearest(rows, queries, score, k, least, own):
    found = []
    for q, x in queries:
        if x is None or len(x) != 8:
            continue
        each = [(-(round(float(score(np.array(x), np.array(v))), 6) + 0.0), i) for i, v in rows if v is not None and len(v) == 8 and None not in v and (own or i != q)]
        each = sorted(e for e in each if least is None or -e[0] >= least)
        found += [(q, i, -s) for s, i in (each if k is None else each[:k])]
    return sorted(found)


def cosine(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return a @ b / size if size else 0.0


def clustered(n=600, spread=0.05):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8))
    return [(i, (centres[rng.integers(20)] + spread * rng.normal(size=8)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("measure", "k", "least", "own"), [("cosine", 5, None, False), ("cosine", 5, 0.9, True), ("cosine", None, 0.2, False), ("distance", None, 0.3, True), ("distance", 7, None, False), ("cosine", 10_000, None, False)])
def test_vector_search_equals_scoring_everything(spark, measure, k, least, own):
    rows = clustered() + [(1000 + i, [1.0] * 8) for i in range(300)] + [(5000, [0.0] * 8), (5001, None), (5002, [1.0]), (5003, [None] + [1.0] * 7), (5004, [-2.0] * 8)]
    queries = [(i, v) for i, v in rows if i % 50 == 0 or i > 5000] + [(9000, [0.0] * 8)]
    queries = [(i, v) for i, v in queries if v is None or None not in v]
    schema = "array<double>"
    index = vector_index.build(spark.createDataFrame(rows, f"vec_id long, embedding {schema}"), measure, name="test")
    found = vector_index.search(index, spark.createDataFrame(queries, f"query_id long, q {schema}"), k, least, own)
    got = sorted((r.query_id, r.vec_id, r.score) for r in found.collect())
    score = cosine if measure == "cosine" else lambda a, b: max(0.0, 1 - np.linalg.norm(a - b) / 2)
    want = plain_nearest(rows, queries, score, k, least, own)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], abs=2e-6)


def test_pairs_grow_less_than_the_rows_where_vectors_cluster(spark):
    counts = []
    for n in (2000, 8000):
        rows = clustered(n, 0.02)
        index = vector_index.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), name="pairs")
        queries = spark.createDataFrame(rows[:40], "query_id long, q array<double>")
        counts.append(vector_index.pairs_multiplied(index, queries, 5) / 40)
        assert counts[-1] < 0.3 * n
    assert counts[1] < 4 * counts[0]


def test_empty_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index = vector_index.build(empty, name="none")
    assert vector_index.search(index, spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>")).count() == 0


def test_a_search_for_all_holds_a_block_of_pairs(monkeypatch):
    """3000 vectors and 40 queries: blocks of bounded size, every pair once."""
    rng = np.random.default_rng(1)
    vectors, clusters = rng.normal(size=(3000, 4)), np.sort(rng.integers(0, 3, 3000))
    centroids = rng.normal(size=(3, 4))
    monkeypatch.setattr(vector_index, "SHELL", 100)
    monkeypatch.setattr(vector_index, "PAIRS", 1000)
    state = vector_index.Every(np.arange(40), vectors[:40], None, False, "cosine")
    blocks = list(state.meet(np.arange(3000), vectors, clusters, np.zeros(3000), centroids))
    assert max(len(at) for at, _, _ in blocks) <= 1000
    pairs = [x for at, place, _ in blocks for x in zip(at.tolist(), place.tolist(), strict=True)]
    assert len(pairs) == len(set(pairs)) == 40 * 3000 - 40 and state.pairs.tolist() == [3000] * 40


def test_a_search_for_all_carries_columns_without_a_join(spark):
    """Of each row its own, where an id comes twice too; nulls stay."""
    rows = [(1, [1.0, 0.0], 5), (1, [0.0, 1.0], 6), (2, [1.0, 1.0], None), (3, [1.0, 0.0], 7)]
    index = vector_index.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), name="also", also=("label",))
    asked = spark.createDataFrame([(2, [1.0, 1.0], None), (3, [1.0, 0.0], 9)], "query_id long, q array<double>, asked int")
    found = vector_index.search(index, asked, None)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = sorted(((r.query_id, r.vec_id, r.score, r.label, r.asked) for r in found.collect()), key=str)
    assert got == sorted([(2, 1, 0.707107, 5, None), (2, 1, 0.707107, 6, None), (2, 3, 0.707107, 7, None), (3, 1, 1.0, 5, 9), (3, 1, 0.0, 6, 9), (3, 2, 0.707107, None, 9)], key=str)
