"""Tables and files in the cluster's shared folder: exports, scans and stored copies."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A path that no other run uses, in the folder of spark.checkpoint.dir, which driver and executors share; only a local master may
    go without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a Parquet table, for what is read more than once: written once, computed once. options: the writer's."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def flattened(df: DataFrame) -> DataFrame:
    """df with the fields of structs as columns a_b, and arrays as text, so that it fits a CSV file."""
    out: list[Column] = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            out += [F.col(f"`{f.name}`.`{x}`").alias(f"{f.name}_{x}") for x in f.dataType.fieldNames()]
        elif f.dataType.typeName() == "array":
            out.append(F.array_join(F.transform(f"`{f.name}`", lambda x: x.cast("string")), ", ").alias(f.name))
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header; quotes are doubled, so that any text comes back as it was."""
    flattened(df).write.option("header", True).option("escape", '"').option("nullValue", "\\N").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", "\\N").csv(path)


def export_json(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON lines, in a folder for each value of ``by``."""
    writer = df.write.option("ignoreNullFields", False)
    (writer.partitionBy(by) if by else writer).json(path)


def scan(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """All files below a folder whose names fit the pattern, as JSON rows and the file they are from."""
    found = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)
    return found.withColumn("file", F.input_file_name())


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime of the files below a folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", "modificationTime")
