"""Folds, spans, paths, files and rules on small fixtures against plain versions."""

import datetime as dt
import random

from pyspark.sql import functions as F

from strandline.functions import rulebook, rules
from strandline.operators import chunking, merging, retrieval, text_index
from strandline.sources import tables
from strandline.streaming import folds


def test_merged_small(spark):
    r = random.Random(5)
    rows = [(d, i, f"c{i}", r.randrange(1, 9)) for d in range(12) for i in range(r.randrange(1, 15))]
    want = []
    for d in range(12):
        done = []
        for _, _, chunk, tokens in [x for x in rows if x[0] == d]:
            if done and done[-1][1] < 10:
                done[-1] = (done[-1][0] + "\n" + chunk, done[-1][1] + tokens)
            else:
                done.append((chunk, tokens))
        want += [(d, i, c, t) for i, (c, t) in enumerate(done)]
    df = spark.createDataFrame(rows, "doc_id long, i int, chunk string, tokens long")
    assert sorted(map(tuple, chunking.merged_small(df, ["i"], 10).collect())) == want
    assert chunking.merged_small(df.limit(0), ["i"], 10).count() == 0


def test_disjoint_spans(spark):
    r = random.Random(6)
    spans = [(d, a, a + r.randrange(12), "k") for d in range(10) for a in [r.randrange(40) for _ in range(9)]]
    want = []
    for d in range(10):
        kept = []
        for s in sorted(((a - b, a, b) for x, a, b, _ in spans if x == d)):
            if all(s[1] > k[2] or k[1] > s[2] for k in kept):
                kept.append(s)
        want += [(d, a, b) for _, a, b in kept]
    got = merging.disjoint_spans(spark.createDataFrame(spans, "doc long, a int, b int, kind string"), "doc").collect()
    assert sorted((x.doc, x.a, x.b) for x in got) == sorted(want)


def lines(spark, text):
    return chunking.typed(spark.createDataFrame([(1, i, x) for i, x in enumerate(text.split("\n"))], "doc_id long, i int, line string"))


def test_chunkers_on_one_document(spark):
    text = "# A\nintro\n## B\n1. one\nmore\n2. two\nWARNING: hot\n3. three\n### C\na | b | c\n1 | 2 | 3\n4 | 5 | 6\n## D\nProblem: off\nSolution: on\nProblem: lone\n# E"
    t = lines(spark, text).cache()
    paths = dict((x.section, x.path) for x in chunking.section_paths(t).collect())
    assert paths == {1: "A", 2: "A > B", 3: "A > B > C", 4: "A > D", 5: "A > E"}
    assert [(x.problem, x.solution) for x in chunking.problem_pairs(t).collect()] == [("off", "on")]
    assert [(x.chunk, x.n_rows) for x in chunking.table_chunks(t, 1).orderBy("part").collect()] == [("a | b | c\n1 | 2 | 3", 1), ("a | b | c\n4 | 5 | 6", 1)]
    assert [(x.label, x.warned) for x in chunking.step_chunks(t, 2).orderBy("part").collect()] == [("1-2", True), ("3-3", False)]
    assert [(x.number, x.last) for x in chunking.steps(t).orderBy("i").collect()] == [(1, 4), (2, 6), (3, 16)]
    found = chunking.sections(t, 10_000).orderBy("section").collect()
    assert [x.heading for x in found] == ["A", "B", "C", "D", "E"] and [x.has_procedure for x in found] == [False, True, False, False, False]
    assert "\n".join(x.chunk for x in found) == text


def test_window_of_an_overlap_larger_than_the_budget():
    assert list(chunking.word_windows("aa bb cc dd", 1, 40)) == ["aa", "bb", "cc", "dd"]


def test_files_come_back(spark):
    rows = [(1, 'a "quoted", text', ["x", "y"]), (2, "two\nlines", []), (3, " spaces ", ["z"])]
    df = spark.createDataFrame(rows, "i long, t string, l array<string>").withColumn("s", F.struct(F.col("i").alias("n")))
    path = tables.shared_path(spark, "csv")
    tables.export_csv(df, path)
    got = tables.read_csv(spark, path, "i long, t string, l string, s_n long").orderBy("i").collect()
    assert [(x.i, x.t, x.l, x.s_n) for x in got] == [(i, t, ", ".join(a), i) for i, t, a in rows]
    path = tables.shared_path(spark, "json")
    tables.export_json(df.select("i", "t", (F.col("i") % 2).alias("p")), path, "p")
    assert sorted((x.i, x.t) for x in tables.scan(spark, path, "i long, t string").collect()) == [(i, t) for i, t, _ in rows]
    assert tables.listing(spark, path, "*.json").filter("length > 0").count() >= 2


def test_versions_and_numbers(spark):
    got = spark.range(1).select(*[(rules.version_parts(F.lit(a), 3) > rules.version_parts(F.lit(b), 3)).alias(f"c{i}") for i, (a, b) in enumerate([("2.5", "2.0"), ("2.0", "2.5"), ("2.5", "2.5.0"), ("2.5.1", "2.5"), ("10", "9.9")])]).first()
    assert tuple(got) == (True, False, False, True, True)
    df = spark.createDataFrame([("Set 5 Nm, 7 rpm", "5 nm and 7.005 RPM"), ("9 kg", "8 kg"), ("none", "5 Nm")], "a string, c string")
    assert [[(x.value, x.unit) for x in r[0]] for r in df.select(rules.ungrounded(F.col("a"), F.col("c"), ["nm", "rpm", "kg"])).collect()] == [[], [(9.0, "kg")], []]


def test_rule_tables(spark):
    types = {"a": {"required": ["x", "y"], "least": 2, "names": ["n"]}, "b": {"required": ["z"], "optional": ["x"]}}
    df = spark.createDataFrame([("x x y", "n"), ("x z", ""), ("x", ""), (None, None)], "t string, n string")
    got = [tuple(r[0]) for r in df.select(rulebook.document_type(F.col("t"), F.col("n"), types)).collect()]
    assert [(a, round(b, 6)) for a, b in got] == [("a", 0.39), ("b", 0.15), ("general", 0.3), ("general", 0.3)]
    intents = df.select(rulebook.labelled_intents(F.col("t"), {"p": ["x"], "q": ["y"], "r": ["z"]}, "E[0-9]+", "code")).collect()
    assert [(r[0].primary, list(r[0].secondaries or [])) for r in intents[:3]] == [("p", ["q"]), ("p", ["r"]), ("p", [])]


def test_bm25_against_a_plain_version(spark):
    import math
    from collections import Counter

    docs = ["alpha beta beta", "gamma alpha", "delta delta delta gamma", ""]
    cut = [[w for w in d.split() if len(w) >= 3] for d in docs]
    mean, n = sum(map(len, cut)) / 4, 4
    df = Counter(w for d in cut for w in set(d))
    score = {}
    for i, d in enumerate(cut):
        for w in ["beta", "gamma", "gamma"]:
            if w in d:
                idf = math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)
                score[i] = score.get(i, 0) + idf * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean))
    found = text_index.search(text_index.build(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")), spark.createDataFrame([(7, "beta gamma gamma")], "query_id long, text string"))
    assert {x.doc_id: round(x.score, 4) for x in found.collect()} == {i: round(s, 4) for i, s in score.items()}
    terms = {x.term: (x.df, x.cf) for x in retrieval.term_frequencies(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert terms == {w: (df[w], sum(d.count(w) for d in cut)) for w in df}


def test_blocked_minutes(spark):
    """A user with five failures a minute apart is blocked for fifteen minutes from the fifth."""
    begin = dt.datetime(2024, 1, 1)
    rows = [(i, "u", begin + dt.timedelta(minutes=i), True) for i in range(5)] + [(9, "v", begin, True)]
    got = folds.progressive_bans(spark.createDataFrame(rows, "event_id long, user string, ts timestamp, failed boolean"), "user").orderBy("event_id").collect()
    assert [(x.attempts, x.blocked) for x in got] == [(1, False), (2, False), (3, False), (4, False), (5, False), (1, False)]
    assert got[4].blocked_until == begin + dt.timedelta(minutes=19) and got[5].blocked_until is None
