"""The semantic and the hybrid chunker against plain loops over whole texts."""

import random
import re
from pathlib import Path

import pytest

from strandline.operators import merging, semantic
from strandline.plans import QUERIES, views

SF = Path("/root/testdata/sf0.001")
UP, LOW = "A-ZÀ-ÖØ-ÞĀĂĄÇĞİÖŞÜÉÈÊ", "a-zß-öø-ÿçğıöşü"
#: Kinds in order of preference; the letters of the fixtures only.
PLAIN = [("numbered", rf"(\d+\.)+\d*\s+[{UP}]"), ("chapter", r"(Chapter|Section|Bölüm|Kısım)\s+\d+"), ("caps", rf"[{UP}][{UP}\s]{{5,50}}$"), ("title", rf"[{UP}][{LOW}]+(\s+[{UP}{LOW}]+){{2,}}$"), ("markdown", r"#{1,6}\s+")]


def plain_windows(text, budget, overlap):
    out, held, cost = [], [], 0
    for w in text.split():
        if held and cost + len(w) // 4 + 1 > budget:
            out.append(" ".join(held))
            held = held[-((overlap + 3) // 4) :] if overlap else []
            cost = sum(len(x) // 4 + 1 for x in held)
            if held and cost + len(w) // 4 + 1 > budget:  # nothing new would fit: a window has a new word at least
                held.append(w)
                cost += len(w) // 4 + 1
                continue
        held.append(w)
        cost += len(w) // 4 + 1
    return out + ([" ".join(held)] if held else [])


def plain_clean(text):
    return re.sub(" {2,}", " ", re.sub("\n{3,}", "\n\n", text or "")).strip()


def kind_of(line):
    line = line.strip(" ")
    if not line or len(line) > 100:
        return None
    return next((k for k, p in PLAIN if re.match(p, line)), None)


def fill(parts, budget, glue):
    out, held, cost = [], [], 0
    for p in parts:
        if held and cost + len(p) // 4 > budget:
            out.append(glue.join(held))
            held, cost = [], 0
        held.append(p)
        cost += len(p) // 4
    return out + ([glue.join(held)] if held else [])


def plain_section(text, budget, overlap):
    if len(text) // 4 <= budget:
        return [text]
    out, small = [], []
    for p in re.split(r"\n\n+", text):
        steps = len(re.findall(r"(?m)^\s*\d+[.)]\s+", p)) >= 3
        if not steps and len(p) // 4 <= budget:
            small.append(p)
            continue
        out += fill(small, budget, "\n\n")
        small = []
        if steps:
            out.append(p)
            continue
        short = []
        for s in re.split(r"(?<=[.?!])\s+", p):
            if len(s) // 4 > budget:
                out += fill(short, budget, " ") + plain_windows(s, budget, overlap)
                short = []
            else:
                short.append(s)
        out += fill(short, budget, " ")
    return out + fill(small, budget, "\n\n")


def plain_semantic(text, budget, least, overlap):
    sections, above = [[None, None, []]], []
    for line in plain_clean(text).split("\n"):
        kind = kind_of(line)
        if kind:
            name = re.sub(r"^#+\s*", "", line.strip(" "))[:50]
            level = len(re.match("#+", line.strip())[0]) - 1 if kind == "markdown" else re.match(r"(\d+\.)+", line.strip())[0].count(".") - 1 if kind == "numbered" else 1 if line.strip().startswith(("Section", "Kısım")) and kind == "chapter" else 0
            above = above[:level] + [name]
            sections.append([kind, " > ".join(above), []])
        sections[-1][2].append(line)
    found, n = [], 0
    for kind, path, lines in sections:
        body = "\n".join(lines).strip()
        if body:
            found += [[n, kind or "body", path, c] for c in plain_section(body, budget, overlap)]
            n += 1
    done = []
    for c in found:
        if done and len(done[-1][3]) // 4 < least:
            done[-1][3] += "\n\n" + c[3]
        else:
            done.append(list(c))
    return [tuple(d) for d in done]


def fixture(seed, n=60):
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "Beta", "gamma", "Délta", "x", "zeta-9", "ÉCOLE"])
    sentence = lambda: " ".join(word() for _ in range(r.choice([2, 5, 9, 40]))) + r.choice([".", "?", "!", "...", ""])
    paragraph = lambda: r.choice([" ", "  ", "\n"]).join(sentence() for _ in range(r.randrange(1, 9)))
    heads = ["# Top", "## Under it", "### Deep one", "1. Intro", "1.2. More Things", "Chapter 3: Begin", "Section 2", "ALL CAPS HEADER", "Title Of This", "Title with 2 digits", "#nospace", "   ## Indented", "# " + "x" * 120]
    steps = "1. open\n2. turn\n3) close"
    block = lambda: r.choice([paragraph, paragraph, lambda: r.choice(heads), lambda: steps])()
    texts = [r.choice(["\n", "\n\n", "\n\n\n\n"]).join(block() for _ in range(r.randrange(0, 14))) for _ in range(n)]
    return texts + [None, "", "  \n ", "# Only", "w " * 900, "a" * 3000, "\x1e# odd\x1e mark"]


@pytest.mark.parametrize(("budget", "least", "overlap"), [(30, 8, 0), (60, 20, 20), (1000, 100, 50)])
def test_semantic_chunks_equal_the_plain_loops(spark, budget, least, overlap):
    texts = fixture(budget)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in semantic.semantic_chunks(docs, budget, least, overlap).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.section, r.kind, r.path, r.chunk))
        assert r.tokens == len(r.chunk) // 4
    for i, t in enumerate(texts[:-1]):
        assert got.get(i, []) == plain_semantic(t, budget, least, overlap), t
    assert "# odd" in got[len(texts) - 1][0][3]


def test_sections_keep_their_kind_path_and_procedures(spark):
    text = "# Chapter 1: Introduction\nThis is what it is about.\n\n## Section 1.1: Start\nHow to.\n\n## Steps\nFollow:\n1. connect it\n2. open it\n3. save it\n\n# Second\nOther."
    rows = semantic.semantic_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 500, 0).orderBy("seq").collect()
    assert [r.path for r in rows] == ["Chapter 1: Introduction", "Chapter 1: Introduction > Section 1.1: Start", "Chapter 1: Introduction > Steps", "Second"]
    assert {r.kind for r in rows} == {"markdown"} or len(rows) > 4
    assert any(all(s in r.chunk for s in ("1. connect", "2. open", "3. save")) for r in rows)


def test_regions_are_disjoint_whole_and_the_larger_stay(spark):
    r = random.Random(3)
    for _ in range(300):
        lines = [r.choice(["prose line", "", "| a | b |", "1. turn it on and wait", "E012: overheated", "12: a | b", "| 1 |", "3. E01: both | kinds"]) for _ in range(r.randrange(0, 25))]
        found = semantic.regions(lines)
        assert [x for _, part in found for x in part] == lines
        assert all(a[0] != "prose" or b[0] != "prose" for a, b in zip(found, found[1:], strict=False))
    spans = [(d, a, a + r.randrange(0, 9), r.choice("xyz")) for d in range(30) for a in r.sample(range(40), 8)]
    kept = {}
    for x in merging.disjoint_spans(spark.createDataFrame(spans, "doc int, a int, b int, kind string"), "doc").collect():
        kept.setdefault(x.doc, []).append((x.a, x.b, x.kind))
    for d in range(30):
        assert semantic.larger_stay([s[1:] for s in spans if s[0] == d]) == sorted(kept[d])


def test_hybrid_chunks_dispatch_each_region(spark):
    text = "Intro line here.\n| name | size |\n|---|---|\n" + "\n".join(f"| r{i} | {i} |" for i in range(7)) + "\nThen prose again.\n" + "\n".join(f"{i}. do the thing number {i}" for i in range(1, 8)) + "\nE010: hot\nE011: cold\nE012: wet"
    rows = semantic.hybrid_chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"), 500, 0).orderBy("doc_id", "seq").collect()
    kinds = [r.kind for r in rows if r.doc_id == 1]
    assert kinds == ["prose", "table", "table", "prose", "procedure", "procedure", "codes"] and {r.doc_id for r in rows} == {1}
    tables = [r.chunk for r in rows if r.kind == "table"]
    assert all(t.startswith("| name | size |\n|---|---|\n") for t in tables) and tables[1].count("\n") == 3
    small = semantic.hybrid_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 500, 1000).collect()
    assert len(small) == 1 and small[0].kind == "prose" and "E012: wet" in small[0].chunk


def plain_hybrid(text, budget, least, overlap):
    done = []
    for kind, lines in semantic.regions(plain_clean(text).split("\n")):
        head = 0 if kind != "table" else 2 if len(lines) > 1 and re.fullmatch(r"[|\s:+-]+", lines[1]) else 1
        groups = ["\n".join(lines[:head] + lines[i : i + 5]) for i in range(head, len(lines), 5)]
        for c in [x[3] for x in plain_semantic("\n".join(lines), budget, least, overlap)] if kind == "prose" else groups:
            if done and len(done[-1][1]) // 4 < least:
                done[-1][1] += "\n\n" + c
            else:
                done.append([kind, c])
    return [tuple(d) for d in done]


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_registered_chunkers_equal_the_plain_loops(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got, whole = {}, {}
    for r in QUERIES["h01_semantic_chunks"](spark, str(SF)).orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.section, r.kind, r.path, r.chunk))
    for i, t in docs.items():
        assert got.get(i, []) == plain_semantic(t, 300, 50, 50)
    planted = {r.doc_id: r.text for r in views.planted_regions(spark, str(SF)).collect()}
    for r in QUERIES["h07_hybrid_chunks"](spark, str(SF)).orderBy("doc_id", "seq").collect():
        whole.setdefault(r.doc_id, []).append((r.kind, r.chunk))
    for i, t in planted.items():
        assert whole.get(i, []) == plain_hybrid(t, 300, 50, 50)
        assert len(re.sub(r"[\s|]", "", t)) >= len(re.sub(r"[\s|]", "", docs[i]))  # planting adds marks and takes nothing
    assert {k for rows in whole.values() for k, _ in rows} == {"prose", "table", "procedure", "codes"}
