"""Derived tables that outlive the query that made them, named by the content they were made from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import shared_path


def content_key(df: DataFrame) -> str:
    """A name for the rows of df, whatever their order: their number, and the sum and the exclusive or of two hashes of each."""
    names = sorted(df.columns)
    salted = lambda seed: F.xxhash64(*[F.col(c) for c in names], F.lit(seed))
    found = df.agg(F.count("*").alias("n"), F.sum(salted(1).cast("decimal(38,0)")).alias("total"), F.bit_xor(salted(2)).alias("mixed")).first()
    return f"{found.n}-{int(found.total or 0) % (1 << 64):016x}-{(found.mixed or 0) % (1 << 64):016x}"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def kept(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of this name in the shared folder; make() gives it where it is not there yet.

    It is written under a draft's name and moved when whole, so a run that fails leaves nothing that another would read, and of two
    that write it at once one wins.
    """
    draft = shared_path(spark, f"draft-{name}")
    path = f"{draft.rpartition('/')[0]}/kept-{name}"
    place, files = _files(spark, path)
    if not files.exists(place):
        make().write.parquet(draft)
        if not files.rename(_files(spark, draft)[0], place) and not files.exists(place):
            raise OSError(f"{draft} could not be moved to {path}")
        files.delete(_files(spark, draft)[0], True)
    return spark.read.parquet(path)
