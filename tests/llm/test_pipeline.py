"""The pipeline's stages against plain versions, and the registered queries against their SQL and plain versions."""

import hashlib
import random
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest

from strandline.llm import queries, quality, toxicity
from test_llm import SCHEMA, labelled, plain_near, plain_windows

BAD = ["idiot", "moron", "scumbag", "worthless"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents with null and repeated ids, copies, near copies, shared passages and toxic texts; labels."""
    path = tmp_path_factory.mktemp("corpus")
    r = random.Random(8)
    rows = [(i, t, "en", "s", len(t), "k", "n", 0, 0) for i, t, _ in labelled(400)]
    words = lambda n: [f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randrange(9000)}" for _ in range(n)]
    base = [words(60) for _ in range(12)]
    more = [" ".join(b) for b in base]
    more += [more[0].upper(), more[1], " ".join([*base[2], "tail"]), "", None, "own " + " ".join(base[3][:40]) + " end", "x" * 120]
    rows += [(1000 + i, t, None, None, None, "k", "n", 0, 0) for i, t in enumerate(more)]
    rows += [(None, " ".join([*base[4], "more"]), None, None, None, "k", "n", 0, 0), (None, " ".join(words(30)), None, None, None, "k", "n", 0, 0), (1005, " ".join(words(30)), None, None, None, "k", "n", 0, 0)]
    rows += [(None, "you idiot moron scumbag " * 3, None, None, None, "k", "n", 0, 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, y, y) for i, _, y in labelled(400)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    clean = corpus_pipeline.clean_documents(spark, docs, path).cache()
    kept = [(x.doc_id, x.text) for x in clean.collect()]
    toxic = {i for i, t, y in labelled(400) if y}
    left = {i for i, _ in kept}
    assert len(toxic & left) <= 0.1 * len(toxic) and len({i for i, _, y in labelled(400) if not y} - left) <= 0.05 * 320
    assert not [t for i, t in kept if i is None and "idiot" in (t or "")] and {i for i, *_ in rows if i and i >= 1000} <= left

    once = corpus_pipeline.exact_copies(spark, clean, path).cache()
    best = {}
    for i, t in kept:
        key = (t or "").lower()
        best[key] = max(best.get(key, -1), -1 if i is None else i)
    want = sorted((str(i), t or "") for i, t in kept if best[(t or "").lower()] == (-1 if i is None else i))
    assert sorted((str(x.doc_id), x.text or "") for x in once.collect()) == want

    near = corpus_pipeline.near_copies(spark, once, path).cache()
    given = sorted(((x.doc_id, x.text) for x in once.collect()), key=lambda x: (x[0] is None, x[0] or 0))
    root = plain_near([t for _, t in given])
    stay = sorted((str(given[i][0]), given[i][1] or "") for i in range(len(given)) if root[i] == i)
    assert sorted((str(x.doc_id), x.text or "") for x in near.collect()) == stay
    assert near.columns == once.columns == corpus_pipeline.COLUMNS

    cut = corpus_pipeline.repeated_passages(spark, near, path).cache()
    ordered = [(x.doc_id, x.text) for x in near.filter("doc_id IS NOT NULL").orderBy("doc_id").collect()]
    plain = plain_windows([t for _, t in ordered], 100)
    want = sorted((i, k.decode()) for (i, _), (n, gone, _, k) in zip(ordered, plain, strict=True) if gone < n or not gone)
    assert sorted((x.doc_id, x.text or "") for x in cut.filter("doc_id IS NOT NULL").collect() if x.doc_id != 1005) == [x for x in want if x[0] != 1005]

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for x in corpus_pipeline.packed(spark, cut, path).collect():
        pieces.setdefault(x.doc_id, []).append((x.start, list(x.ids)))
    for x in cut.filter("doc_id < 1005").collect():
        assert [i for _, p in sorted(pieces[x.doc_id]) for i in p] == [*tok.encode(x.text or "", add_special_tokens=False).ids, 2]


def test_run(spark, folder):
    path, _ = folder
    found = corpus_pipeline.run(spark, path).collect()
    of = {}
    for x in found:
        of.setdefault((x.sequence_id), []).append((x.offset, x.length))
    for pieces in of.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *[n for _, n in pieces[:-1]]]).tolist()
        total = sum(n for _, n in pieces)
        assert total == 4096 or total & (total - 1) == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    rel = con.sql(queries.ORACLE_SQL[name])
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    want = sorted(tuple(map(str, (r[rel.columns.index(c)] for c in cols))) for r in rel.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == want


def test_toxicity_query_against_a_plain_version(spark, folder):
    """The query's scores are those of the model, applied bag by bag by plain code."""
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.fit_labelled(docs, spark.read.parquet(f"{path}/labels.parquet"))

    def plain(text):
        words = (text or "").lower().split()
        halves = [words[i : i + 4] for i in range(0, len(words), 4)]
        bags = [a + b for a, b in zip(halves, halves[1:], strict=False)] or halves
        worst = model.bias
        if bags:
            worst = max(sum(model.word_scores([w])[0][0] for w in b) / sum(model.word_scores([w])[1][0] for w in b) for b in bags) + model.bias
        return 1 / (1 + np.exp(-np.clip(model.slope * worst + model.level, -30, 30)))

    got = queries.op2_subword_toxicity(spark, path).collect()
    assert len(got) == len(rows) and sum(x.held_out for x in got) == sum(i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows)
    by_id = {x.doc_id: x for x in got}
    for i, t, *_ in rows[::17]:
        if i is not None and i != 1005:
            assert abs(by_id[i].score - plain(t)) < 1e-9 and by_id[i].predicted == int(plain(t) >= 0.3)
    again = toxicity.fit_labelled(docs.limit(0), spark.read.parquet(f"{path}/labels.parquet"))
    assert toxicity.score(docs, again).count() == len(rows)


def test_quality_query_against_a_plain_version(spark, folder):
    """The scores of the table of features are those of plain sums over a document's words; held-out labels are found."""
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{path}/labels.parquet"))
    got = {x.doc_id: x for x in queries.op7_co_trained_quality(spark, path).collect()}
    for i, t, lang, source, n, *_ in rows[::23]:
        if i is not None and i != 1005:
            row = (t or "", lang or "", source or "", n if n is not None else len(t or ""))
            views = [sum(float(w[b]) * float(np.float32(v)) for b, v in zip(*f(row), strict=True)) for f, w in ((quality.text_features, model.text), (quality.page_features, model.page))]
            z = [a * v + c for v, (a, c) in zip(views, model.calibration, strict=True)]
            both = model.weights[0] * z[0] + model.weights[1] * z[1] + model.weights[2]
            assert abs(got[i].score - 1 / (1 + np.exp(-np.clip(both, -30, 30)))) < 1e-6
    held = [(i, y) for i, _, y in labelled(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == y for i, y in held) >= 0.8 * len(held)
    assert quality.score(docs.limit(0), model).count() == 0


def test_packing_query_against_the_library(spark, folder):
    path, rows = folder
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.op1_sum_of_squares_packing(spark, path).collect()
    counts = {}
    for i, t, *_ in rows:
        counts[i] = counts.get(i, 0) + len(tok.encode(t or "", add_special_tokens=False).ids) + 1
    held = {}
    for x in got:
        held[x.doc_id] = held.get(x.doc_id, 0) + x.length
    assert held == counts


def test_codec_query_against_the_library(spark, folder):
    import sentencepiece

    path, rows = folder
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {x.doc_id: x for x in queries.op4_piece_encode_decode(spark, path).collect()}
    for i, t, *_ in rows[::19]:
        if i is not None and i != 1005:
            ids = sp.encode(t or "")
            assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
