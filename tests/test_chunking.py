"""Chunkers and event-time windows on small fixtures."""

from pyspark.sql import functions as F

from strandline.operators.chunking import split_by_words, word_windows
from strandline.streaming.windows import window_metrics


def test_word_windows(spark):
    assert list(word_windows("aa bb cc dd ee", 2, 0)) == ["aa bb", "cc dd", "ee"]
    assert list(word_windows("aa bb cc dd", 3, 4)) == ["aa bb cc", "cc dd"]
    assert list(word_windows("x" * 400 + " y", 5, 0)) == ["x" * 400, "y"]
    df = spark.createDataFrame([(1, "aa bb cc"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in split_by_words(df, budget=2).collect()] == [(1, 0, "aa bb"), (1, 1, "cc")]


def test_stream_equals_table(spark, tmp_path):
    events = spark.range(300).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("latency"))
    events.write.parquet(str(tmp_path / "in"))
    stream = window_metrics(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("metrics_seen").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("metrics_seen").collect())) == sorted(map(tuple, window_metrics(events).collect()))
