"""Lists of variants one after the other, and limits per group, against plain loops."""

from pyspark.sql import functions as F

from strandline.operators import retrieval


def test_places_run_over_the_lists_of_variants(spark):
    rows = [(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "b", 1), (1, 3, "c", 1), (2, 2, "a", 1)]
    got = retrieval.concatenated(spark.createDataFrame(rows, "q int, variant int, doc string, rank int"), "q", "variant")
    assert sorted((x.q, x.variant, x.doc, x.place) for x in got.collect()) == [(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "b", 3), (1, 3, "c", 4), (2, 2, "a", 1)]


def test_only_marked_rows_are_limited(spark):
    rows = [("x", i, i % 2 == 0) for i in range(10)] + [("y", 1, None), ("y", 2, True), (None, 3, True)]
    df = spark.createDataFrame(rows, "k string, i int, bulletin boolean")
    got = retrieval.limited(df, ["k"], [F.desc("i")], 2, F.col("bulletin")).collect()
    want = [("x", i) for i in (1, 3, 5, 6, 7, 8, 9)] + [("y", 1), ("y", 2), (None, 3)]
    assert sorted(((x.k, x.i) for x in got), key=str) == sorted(want, key=str)
    assert set(got[0].asDict()) == {"k", "i", "bulletin"}
