"""Marks of sets: what they rule out before pairs are made, and that they rule out no near copy."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import simhash


def test_bits_apart_never_exceed_the_shingles_that_differ(spark):
    """Sets of 0 to 3000 hashes, so with one to some hundred words of marks, compared across sizes."""
    r = random.Random(53)
    pool = [r.getrandbits(64) for _ in range(3000)]
    sets = [sorted(pool[: (7 * k * k) % 3000] + [r.getrandbits(64) for _ in range(k % 5)]) for k in range(24)] + [[]]
    marked = spark.createDataFrame([(i, simhash.marks(np.array(s, np.uint64).view(np.int64)).tolist()) for i, s in enumerate(sets)], "id int, marks array<long>")
    x, y = marked.selectExpr("id a", "marks x"), marked.selectExpr("id b", "marks y")
    apart = {(p.a, p.b): p.n for p in x.crossJoin(y).select("a", "b", simhash.bits_apart("x", "y").alias("n")).collect()}
    assert len(apart) == len(sets) ** 2
    for (a, b), n in apart.items():
        different = len(set(sets[a]) ^ set(sets[b]))
        assert n <= different and (n > 0 or a == b or different < 10)


def test_unlike_texts_of_one_template_are_not_proposed(spark):
    """Documents that share rare shingles, half of their words, were all proposed in pairs; now the near ones alone are, nearly."""
    r = random.Random(59)
    frame, texts = [f"t{r.randrange(9000)}" for _ in range(100)], []
    for k in range(150):
        own = [f"w{r.randrange(9000)}" for _ in range(100)]
        texts.append(" ".join(own + frame))
        if k % 10 == 0:
            texts.append(" ".join([*own, *frame[:-5], f"x{k}"]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = simhash.sketches(docs).groupBy("fp").agg(F.first("shingles").alias("shingles")).cache()
    shingles = {x.fp: set(x.shingles) for x in sets.collect()}
    near = {(a, b) for a in shingles for b in shingles if a > b and 5 * len(shingles[a] & shingles[b]) >= 4 * len(shingles[a] | shingles[b])}
    assert len(near) == 15
    none = spark.createDataFrame([], "node long, root long")
    proposed = [(x.a, x.b) for x in simhash.exact_pairs(sets, none, len(shingles)).collect()]
    assert near <= set(proposed) and len(proposed) < 30
