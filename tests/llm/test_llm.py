"""The operators of strandline.llm against plain versions on small tables with awkward rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import ann, exact_dedup, line_dedup, packing, piece_codec, quality, simhash, suffix_dedup, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, norm string, doc long, h long"
WORDS = ["alpha", "beta", "gamma", "delta", "Épée", "naïve", "x", "it's", "12", "--", "中文"]


def table(spark, texts, ids=None):
    """Documents with extra columns whose names clash with those that operators use inside."""
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, None, "s", None, "k", "n", 7, 8) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def random_texts(seed=3, n=60):
    r = random.Random(seed)
    base = [" ".join(r.choice(WORDS) for _ in range(r.randrange(1, 120))) for _ in range(n)]
    texts = base + [None, "", " ", "\n\n", "A", "a", "word " * 3000]
    texts += [base[1].upper(), base[2], base[2], base[3] + " tail", base[4][:200] + " cut " + base[5], "y" * 400, "z" + "y" * 300]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, random_texts()).cache()


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_packing_holds_every_id_once(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, capacity=256).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for i, text in enumerate(random_texts()):
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        assert [x for r in pieces for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in pieces)
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
        total = sum(r.length for r in pieces)
        assert total == 256 or total < 256 and total & (total - 1) == 0
    assert packing.pack(docs.limit(0), path).count() == 0


def test_sum_of_squares_choice():
    p = packing.SumOfSquares(10)
    for n in (6, 6, 4):
        p.add("d", b"\0" * 4 * n)
    # levels {6: 2}; 4 fills a window of 6 rather than opening a third
    assert p.counts[6] == 1 and len(p.ready) == 1


def test_exact_dedup(spark):
    texts = random_texts() + ["CaSe É", "case É", "case é"]
    ids = list(range(len(texts)))
    docs = table(spark, texts, ids)
    norm = [(t or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)) for t in texts]
    want = [(i, max(j for j in ids if norm[j] == n), norm.count(n), i == max(j for j in ids if norm[j] == n), hashlib.sha256(n.encode()).hexdigest()) for i, n in zip(ids, norm, strict=True)]
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert collected(exact_dedup.exact_groups(docs), *cols) == sorted(want, key=str)
    # tiny buckets make the directory double
    assert collected(exact_dedup.exact_groups(docs, bucket_keys=2), *cols) == sorted(want, key=str)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0
    assert exact_dedup.exact_dedup(docs).count() == len(set(norm))
    nulls = table(spark, ["a", "A", "b", "b"], [None, 4, None, None])
    assert collected(exact_dedup.exact_groups(nulls), "doc_id", "keep_id", "kept") == sorted([(None, 4, False), (4, 4, True), (None, None, True), (None, None, True)], key=str)


def test_piece_codec(spark, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    texts = random_texts() + ["  a  b   ", "▁x", "aaaa" * 50, " " * 700 + "q", "\U0001f600 é́", "\0\x0012 a"] + ["".join(r.choice("ab =-.\n") for _ in range(60)) for _ in range(300)]
    for row in piece_codec.encode_decode(table(spark, texts), path).collect():
        ids = sp.encode(texts[row.doc_id] or "")
        assert row.ids == ids and row.decoded == sp.decode(ids)
    assert piece_codec.encode_decode(docs.limit(0), path).count() == 0


def plain_fingerprint(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, radius):
    root = list(range(len(values)))
    for _ in values:
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if bin(a ^ b).count("1") <= radius:
                    root[i] = min(root[i], root[j])
    return root


def test_near_copies(spark):
    r = random.Random(11)
    base = [[f"w{r.randrange(4000)}" for _ in range(n)] for n in (80, 200, 900)]
    texts = [" ".join(w) for w in base]
    for w in base:  # one word in eighty differs: a similarity of 0.8 or more
        texts.append(" ".join("other" if i % 80 == 40 else x for i, x in enumerate(w)))
    texts += [" ".join(f"v{r.randrange(4000)}" for _ in range(300)), None, "", "short text", "Short TEXT"]
    docs = table(spark, texts)
    found = dict(collected(simhash.near_components(docs), "doc_id", "component_id"))
    assert found == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 2, 6: 6, 7: 7, 8: 7, 9: 9, 10: 9}
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns and collected(kept, "doc_id") == sorted([(0,), (1,), (2,), (6,), (7,), (9,)], key=str)
    assert simhash.near_components(docs.limit(0)).count() == 0
    sketched = simhash.sketches(docs).groupBy("fp").agg(F.first("wide").alias("wide"), F.first("cells").alias("cells"))
    for size in (64, 1):  # small cells, and crowded ones
        links = {frozenset((x.a, x.b)) for x in simhash.similar_links(sketched, 0.8, bucket_size=size).collect()}
        assert len(links) == 3


def test_simhash(spark, docs):
    texts = random_texts()
    fps = [plain_fingerprint(t, 3) for t in texts]
    roots = plain_components(fps, 2)
    want = [(i, f"{f:016x}", r) for i, (f, r) in enumerate(zip(fps, roots, strict=True))]
    assert collected(simhash.simhash_components(docs), "doc_id", "fingerprint", "component_id") == sorted(want, key=str)
    assert simhash.simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_size", [64, 2])
def test_fingerprint_links_lose_nothing(spark, bucket_size):
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(12)]
    values = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randrange(4))) for b in base for _ in range(12)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, bucket_size)
    from strandline.llm.components import connected_components

    found = {x.node: x.root for x in connected_components(links).collect()}
    got = [found.get(v, v) for v in signed]
    want = plain_components(values, 2)
    assert len({(a, b) for a, b in zip(got, want, strict=True)}) == len(set(want)) == len(set(got))


def plain_lines(texts, m, min_chars=300):
    lines = [(t or "").split("\n") for t in texts]
    seen, passages, out = set(), set(), []
    for ls in lines:
        gone = set()
        for i in range(len(ls) - m + 1):
            run = tuple(ls[i : i + m])
            if run in seen:
                gone.update(range(i, i + m))
            seen.add(run)
        for i, x in enumerate(ls):
            if len(x) >= min_chars and x in passages:
                gone.add(i)
            passages.add(x)
        out.append((len(ls), len(gone), sum(1 for i in gone if i - 1 not in gone), "\n".join(x for i, x in enumerate(ls) if i not in gone)))
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 5])
def test_line_dedup(spark, m):
    r = random.Random(m)
    texts = [None, "", "a", "a\na\na\na\na", "p" * 300, "x\n" + "p" * 300 + "\ny", "p" * 299, "q\n" + "p" * 299] + ["\n".join(r.choice("abcd") for _ in range(r.randrange(1, 14))) for _ in range(40)]
    got = line_dedup.line_dedup(table(spark, texts), min_lines=m)
    want = [(i, *x) for i, x in enumerate(plain_lines(texts, m))]
    assert collected(got, "doc_id", "n_lines", "n_removed", "n_runs", "kept_text") == sorted(want, key=str)


def plain_windows(texts, width):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - width + 1):
            if b[s : s + width] in seen:
                gone[s : s + width] = True
            seen.add(b[s : s + width])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept))
    return out


@pytest.mark.parametrize("width,gram", [(100, 40), (20, 8)])
def test_suffix_dedup(spark, width, gram):
    r = random.Random(width)
    shared = ["".join(r.choice("abcde é") for _ in range(r.randrange(90, 260))) for _ in range(6)]
    texts = random_texts() + [shared[r.randrange(6)][r.randrange(40) :] + "".join(r.choice("xyz ") for _ in range(r.randrange(60))) + shared[r.randrange(6)][: r.randrange(60, 200)] for _ in range(60)]
    got = suffix_dedup.suffix_dedup(table(spark, texts), width=width, gram=gram, carry=["source"])
    want = [(i, a, b, c, k) for i, (a, b, c, k) in enumerate(plain_windows(texts, width))]
    rows = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got.collect())
    assert rows == want
    assert suffix_dedup.suffix_dedup(table(spark, [])).count() == 0
    assert suffix_dedup.suffix_dedup(table(spark, ["q" * 300, "q" * 300, None], [None, 5, 5])).count() == 3


def test_suffix_dedup_crowded_lead(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", 10)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 150)  # texts in several pieces
    r = random.Random(2)
    core = "".join(r.choice("abcdefgh") for _ in range(140))
    texts = ["".join(r.choice("xyz") for _ in range(50)) + core + "".join(r.choice("xyz") for _ in range(50)) for _ in range(30)]
    want = [(i, a, b, c, k) for i, (a, b, c, k) in enumerate(plain_windows(texts, 100))]
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix_dedup.suffix_dedup(table(spark, texts)).collect()) == want


def test_warc_round_trip(spark):
    pages = [(1, "http://a/ü\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>é</p>"), (9, "u", "z\r\n\r\n" * 2000), (9, "v", "z\r\n\r\n" * 2000), (None, "w", "only")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = collected(warc.round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        ids = [j for j, _, g in pages if (g or "") == (h or "") and j is not None]
        keep = max(ids) if ids else None
        revisit = keep is not None and i != keep
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", keep if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_reader_rejects_damage():
    import io

    raw = warc.record(1, "u", b"payload", warc.digest(b"payload"), None, False)
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r", b"paYload\r"))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = packer.compress(raw) + packer.flush()
    assert [warc.parse(x)[2] for x in warc.records(io.BytesIO(data * 3))] == [b"payload"] * 3
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-9])))


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)) + 2 * rng.normal(size=(30, 32))[rng.integers(0, 30, 3000)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] * 32), (5003, [1.0]), (None, [1.0] * 32), (5004, [None] * 32)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("vec_id") % 100 == 0, k=10, block_rows=800, query_rows=20).collect()
    hits = 0
    for q in range(0, 3000, 100):
        s = x @ x[q]
        s[q] = -np.inf
        mine = [r for r in got if r.query_id == q]
        assert [r.rank for r in sorted(mine, key=lambda r: (-r.score, r.vec_id))] == list(range(1, 11))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in mine)
        hits += len({r.vec_id for r in mine} & set(np.argsort(-s, kind="stable")[:10].tolist()))
    assert hits >= 0.9 * 300
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(i, [1.0, 2.0]) for i in (3, 1, 2)], "vec_id long, embedding array<double>")
    assert collected(ann.nearest(few, F.col("vec_id") == 2, k=5), "rank", "vec_id") == [(1, 1), (2, 3)]


def labelled(n=600, seed=4):
    r = random.Random(seed)
    bad = ["idiot", "moron", "scumbag", "worthless"]
    out = []
    for i in range(n):
        words = ["".join(r.choice("aeiounrst") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(5, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(bad))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_toxicity(spark):
    rows = labelled()
    docs = table(spark, [t for _, t, _ in rows] + [None, "", "you moronn", "such an idiott"])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit_labelled(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum(got[i].predicted == rows[i][2] for i in held)
    assert len(got) == 604 and right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[600].score == got[601].score
    assert got[602].predicted == 1 and got[603].predicted == 1  # misspellings nobody labelled
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_quality(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice(["good", "clear", "lines", "of", "text"] if i % 2 else ["###", "$$$", "&&&", "of", "x"]) for _ in range(40)) for i in range(300)]
    docs = table(spark, [*texts, None])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.score(docs, quality.fit(docs, labels)).collect()}
    assert sum(got[i].predicted == i % 2 for i in range(200, 300)) >= 95 and len(got) == 301
    assert quality.score(docs, quality.fit(docs.limit(0), labels)).count() == 301


def test_crowded_near_copies_stay_together(spark):
    """Two large groups of near copies, whose sample cells are all crowded, and unlike texts between them."""
    r = random.Random(29)
    bases = [[f"{c}{r.randrange(4000)}" for _ in range(300)] for c in "ab"]
    texts = []
    for i in range(90):
        words = list(bases[i % 2])
        for at in r.sample(range(300), 2):
            words[at] = f"new{i}"
        texts.append(" ".join(words))
    texts += [" ".join(f"c{r.randrange(4000)}" for _ in range(100)) for _ in range(5)]
    rows = simhash.sketches(table(spark, texts))
    found = simhash.similar_links(rows.select("fp", "wide", "cells"), 0.8, bucket_size=8)
    root = {x.fp: x.fp for x in rows.select("fp").collect()}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for link in found.collect():
        a, b = sorted((top(link.a), top(link.b)))
        root[b] = a
    of = {x.doc_id: top(x.fp) for x in rows.select("doc_id", "fp").collect()}
    assert len({of[i] for i in range(0, 90, 2)}) == len({of[i] for i in range(1, 90, 2)}) == 1
    assert len(set(of.values())) == 7


def jaccard(a, b):
    a, b = (set(simhash.shingle_hashes(t).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_links_are_verified(spark):
    """Texts whose sets of shingles have a similarity of 0.65 to 0.79 never link, those of 0.8 or more do."""
    r = random.Random(41)
    texts = []
    for k in range(40):
        words = [f"w{r.randrange(9000)}" for _ in range(200)]
        other = list(words)
        for at in range(30, 30 + 12 * (3 + k % 3), 12):  # each changed word takes five shingles of 196
            other[at] = f"new{k}"
        texts += [" ".join(words), " ".join(other)]
    near = [jaccard(texts[i], texts[i + 1]) >= 0.8 for i in range(0, 80, 2)]
    assert min(jaccard(texts[i], texts[i + 1]) for i in range(0, 80, 2)) > 0.65 and 10 < sum(near) < 30
    of = dict(collected(simhash.near_components(table(spark, texts)), "doc_id", "component_id"))
    assert not [i for i, n in enumerate(near) if not n and of[2 * i] == of[2 * i + 1]]


def plain_near(texts, similarity=0.8):
    """The smallest index that each text reaches over all pairs of that similarity."""
    sets = [set(simhash.shingle_hashes(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b)):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    return root


def test_near_copies_in_crowded_cells_of_unlike_texts(spark):
    """Documents of one template, mostly of a similarity below 0.8, with a few near pairs among them: all pairs are found."""
    r = random.Random(43)
    frame = [f"t{r.randrange(9000)}" for _ in range(80)]
    texts = []
    for k in range(220):
        own = [f"w{r.randrange(9000)}" for _ in range(20)]
        texts.append(" ".join(frame + own))
        if k % 6 == 0:  # a near copy: one own word more
            texts.append(" ".join([*frame, *own, f"x{k}"]))
        if k % 6 == 1:  # near it, or nearly so
            texts.append(" ".join(["y", *frame[4:], *own[: 20 - k % 9]]))
    want = plain_near(texts)
    assert len(set(want)) > 150
    docs = table(spark, texts)
    assert dict(collected(simhash.near_components(docs), "doc_id", "component_id")) == dict(enumerate(want))
    # the join alone, without what the samples find, in small blocks and in large ones
    sets = simhash.sketches(docs).groupBy("fp").agg(F.first("shingles").alias("shingles")).cache()
    shingles = {x.fp: set(x.shingles) for x in sets.collect()}
    fps = sorted(shingles)
    near = {(a, b) for a in fps for b in fps if a > b and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])}
    none = spark.createDataFrame([], "node long, root long")
    for block in (7, 1000):
        assert {(x.a, x.b) for x in simhash.verified(simhash.exact_pairs(sets, none, len(fps), 0.8, block), sets).collect()} == near


def test_short_near_copies(spark):
    """Pairs of 8 to 12 words, one with a word more at an end: 4/5, 5/6, 6/7 and 7/8 shingles; and one of 3/4, which is less."""
    r = random.Random(47)
    texts = []
    for k in range(30):
        words = [f"w{r.randrange(9000)}" for _ in range(7 + k % 5)]
        texts += [" ".join(words), " ".join([*words, "more"] if k % 2 else ["more", *words])]
    want = plain_near(texts)
    assert [want[i + 1] == i for i in range(0, 60, 2)] == [k % 5 > 0 for k in range(30)]
    assert dict(collected(simhash.near_components(table(spark, texts)), "doc_id", "component_id")) == dict(enumerate(want))


def test_exact_dedup_keeps_other_texts_of_an_id(spark):
    """A null id and a repeated one, each with a copy of another's text and with texts of its own."""
    docs = table(spark, ["a", "A", "own", None, "b", "B", "else"], [None, 5, None, None, 3, 7, 3])
    assert collected(exact_dedup.exact_dedup(docs), "doc_id", "text") == sorted([(5, "A"), (None, "own"), (None, None), (7, "B"), (3, "else")], key=str)


def test_quality_scores_all_unlabelled(spark):
    """The surest of all unlabelled documents are taken, a very long one and one with a null id among them."""
    r = random.Random(3)
    texts = [" ".join(r.choice(["good", "bad", "of", "text", "x"]) for _ in range(40)) for _ in range(3300)]
    texts += ["good " * 6000, "bad " * 50]
    docs = table(spark, texts, [*range(3301), None])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    pool = quality.Unlabelled(docs, labels)
    assert pool.rows.count() == 3262
    weight = np.zeros(quality.TEXT_BUCKETS)
    for word, w in (("good", 1.0), ("bad", -1.0)):
        weight[zlib.crc32(word.encode()) % (quality.TEXT_BUCKETS - 32)] = w
    keys = {x.doc_id: x.key for x in docs.select("doc_id", F.xxhash64("doc_id", "text", "lang", "source", "n_chars").alias("key")).collect()}
    z = {i: quality.Stack([quality.text_features((t, "", "s", 7))]).logits(weight)[0] for i, t in zip([*range(3301), None], texts, strict=True) if i is None or i >= 40}
    order = sorted(z, key=lambda i: z[i])
    low, high = pool.surest([weight, np.zeros(quality.PAGE_BUCKETS)], [set(), set()], 1, 1)[0]
    assert low == [keys[None]] == [keys[order[0]]] and high == [keys[3300]] == [keys[order[-1]]]
    low, high = pool.surest([weight, np.zeros(quality.PAGE_BUCKETS)], [{*low, *high}, set()], 20, 20)[0]
    assert z[order[1]] == min(z[i] for i in z if keys[i] in low) and not {keys[None], keys[3300]} & {*low, *high} and len(low) == len(high) == 20
    assert set(pool.features({keys[3300]})) == {keys[3300]}


def test_sieved_join(spark, monkeypatch):
    """Exact whether few bits are marked or all, with repeated rows and no keys at all."""
    from strandline.llm import shared

    left = spark.createDataFrame([(7 * i - 900, [i]) for i in range(400)] + [(i, [i]) for i in range(9)], "k long, wide array<long>")
    keys = spark.createDataFrame([(i,) for i in range(1500)], "k long")
    for words in (1 << 17, 1):
        monkeypatch.setattr(shared, "SIEVE_WORDS", words)
        for how in ("left_semi", "left_anti"):
            for some in (keys, keys.limit(0)):
                found = shared.sieved_join(left, some, "k", how).select("k", "wide")
                assert sorted(map(tuple, found.collect())) == sorted(map(tuple, left.join(some, "k", how).select("k", "wide").collect()))
