"""Many-pattern matching against plain loops."""

import random

from pyspark.sql import functions as F

from strandline.operators import patterns

TEXTS = ["", None, "aaaa", "abcabcab", "bca" * 50, "É ünlü 𝄞 ab", "ab", "xyz"]


def plain(texts, of):
    return {(i, p, s.count(p), s.index(p) + 1) for i, s in enumerate(texts) for p in {x for x in of if x} if s and p in s}


def found(spark, texts, of, **how):
    docs = spark.createDataFrame([(i, s, "clash") for i, s in enumerate(texts)], "doc long, s string, pattern string")
    rules = spark.createDataFrame([(p,) for p in of], "p string")
    got = patterns.substring_matches(docs, "doc", F.col("s"), rules, "p", **how).collect()
    assert len(got) == len(set(got))
    return {tuple(x) for x in got}


def test_patterns_that_nest_overlap_and_repeat(spark):
    of = ["a", "aa", "ab", "abcab", "bca", "cabca", "𝄞", "ünlü", "", None, "ab", "zz"]
    assert found(spark, TEXTS, of) == plain(TEXTS, of)
    assert found(spark, TEXTS, of, most_chars=0) == plain(TEXTS, of)


def test_hundreds_of_patterns_both_ways(spark):
    r = random.Random(5)
    texts = ["".join(r.choice("abc") for _ in range(r.randint(0, 300))) for _ in range(20)]
    of = ["".join(r.choice("abc") for _ in range(r.randint(3, 7))) for _ in range(300)]
    assert found(spark, texts, of) == plain(texts, of) == found(spark, texts, of, most_chars=10)


def test_no_patterns_and_no_texts(spark):
    assert found(spark, TEXTS, []) == set() == found(spark, [], ["a"]) == found(spark, TEXTS, [None, ""])


def test_first_prefix(spark):
    rules = [("S", 4), ("STANDARD", 1), ("PROMO", 2), ("SMALL", 3), ("SM", 3), (None, 0), ("STANDARD", 9)]
    values = ["STANDARD X", "SMALL", "S", "", None, "PROM", "sx"]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v string")
    got = {x.id: x.prefix for x in patterns.first_prefix(df, "id", F.col("v"), spark.createDataFrame(rules, "prefix string, place int"), "prefix", "place").collect()}
    assert got == {0: "STANDARD", 1: "SM", 2: "S", 3: None, 4: None, 5: None, 6: None}
    every = patterns.first_prefix(df, "id", F.col("v"), spark.createDataFrame([("", 1)], "prefix string, place int"), "prefix", "place")
    assert {x.id for x in every.collect() if x.prefix == ""} == {0, 1, 2, 3, 5, 6}
    assert {x.prefix for x in patterns.first_prefix(df, "id", F.col("v"), spark.createDataFrame([], "prefix string, place int"), "prefix", "place").collect()} == {None}
