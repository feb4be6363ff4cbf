"""A table of which every change makes a new version: only the parts that a change touches are written again.

A row belongs to one of ``parts`` parts, by the hashes of its key and of ``by`` (a source, say): the rows of one value of ``by`` lie in at
most ``spread`` parts, so replacing a source leaves the others' files as they are, and a source that holds a third of all rows is still
split. A version is one small file that names the folder of each part (at most ``parts`` of them) and is moved into place when all data
are written, so readers see a version whole or not at all, and earlier versions can still be read. A writer that another one has
overtaken is told so (FileExistsError) and changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .kept import _files

PART = "__part"


@dataclass(frozen=True)
class Versions:
    """The table below ``path``. Rows are told apart by ``key``, or by ``by`` and ``key`` where ``by`` is given: a row whose ``by`` changes is
    another row. Rows with a null key are never merged, each is a row of its own."""

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    by: str | None = None
    parts: int = 64
    spread: int = 8

    def part(self) -> Column:
        place = F.pmod(F.xxhash64(self.key), F.lit(self.spread if self.by else self.parts))
        return (F.pmod(F.xxhash64(self.by), F.lit(self.parts)) + place) % self.parts if self.by else place

    def latest(self) -> int:
        """The number of the last version; 0 is the empty table before any change."""
        place, files = _files(self.spark, f"{self.path}/versions")
        names = [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def folders(self, version: int) -> dict[int, str]:
        """part -> folder, of a version."""
        if version == 0:
            return {}
        text = self.spark.read.text(f"{self.path}/versions/v{version:09d}.json", wholetext=True).first()[0]
        return {int(p): f for p, f in json.loads(text).items()}

    def read(self, version: int | None = None, parts: set[int] | None = None) -> DataFrame:
        """The rows of a version (the last one), or of some of its parts."""
        found = self.folders(self.latest() if version is None else version)
        chosen = [f"{self.path}/{f}" for p, f in sorted(found.items()) if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*chosen) if chosen else self.spark.createDataFrame([], self.schema)

    def _touched(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.part().cast("int")).distinct().collect()}  # at most self.parts numbers

    def _publish(self, base: int, rows: DataFrame, touched: set[int]) -> int:
        """Version base + 1: the folders of base, but for the touched parts, which hold rows."""
        folder = f"data/{uuid.uuid4().hex}"
        named = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]).withColumn(PART, self.part().cast("int"))
        named.hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(f"{self.path}/{folder}")
        place, files = _files(self.spark, f"{self.path}/{folder}")
        written = [x.getPath().getName() for x in files.listStatus(place) if x.isDirectory()]
        made = {int(n.partition("=")[2]): f"{folder}/{n}" for n in written if n.startswith(PART)}
        if stray := set(made) - touched:
            raise ValueError(f"a change wrote rows of parts {sorted(stray)}, which it had not read")
        self._switch(base + 1, {p: f for p, f in self.folders(base).items() if p not in touched} | made)
        return base + 1

    def _switch(self, version: int, folders: dict[int, str]) -> None:
        draft, files = _files(self.spark, f"{self.path}/drafts/{uuid.uuid4().hex}")
        target, _ = _files(self.spark, f"{self.path}/versions/v{version:09d}.json")
        out = files.create(draft)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        files.mkdirs(target.getParent())
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        option = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = gateway.new_array(option, 1)
        options[0] = option.NONE  # an existing version is not overwritten
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, target, options)
        except Exception as e:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(f"version {version} of {self.path} was written meanwhile") from e
            raise

    def change(self, new: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Version of which the touched parts hold merge(their old rows, new). A key that comes twice in new is a ValueError."""
        keys = [self.by, self.key] if self.by else [self.key]
        twice = new.filter(F.col(self.key).isNotNull()).groupBy(*keys).count().filter("count > 1").first()
        if twice is not None:
            raise ValueError(f"{twice[:-1]} comes {twice[-1]} times among the new rows")
        base, touched = self.latest(), self._touched(new)
        return self._publish(base, merge(self.read(base, touched), new), touched) if touched else base

    def replace(self, values: list, rows: DataFrame) -> int:
        """Delete the rows of these values of ``by`` and insert others, in one version."""
        if self.by is None:
            raise ValueError("the table has no column to replace rows by")
        base, gone = self.latest(), F.col(self.by).isin([v for v in values if v is not None])
        if None in values:
            gone = gone | F.col(self.by).isNull()
        gone = F.coalesce(gone, F.lit(False))
        touched = self._touched(self.read(base).filter(gone)) | self._touched(rows)
        return self._publish(base, self.read(base, touched).filter(~gone).unionByName(rows.select(*self.schema.names)), touched) if touched else base

    def insert(self, rows: DataFrame) -> int:
        """Rows added, whatever their keys."""
        base, touched = self.latest(), self._touched(rows)
        return self._publish(base, self.read(base, touched).unionByName(rows.select(*self.schema.names)), touched) if touched else base

    def purge(self, unwanted: Column, dry_run: bool = False) -> tuple[int, int]:
        """(version, rows that unwanted is true of); with dry_run nothing is deleted. Only parts with such rows are written again."""
        base, bad = self.latest(), F.coalesce(unwanted, F.lit(False))
        found = self.read(base).filter(bad).groupBy(self.part().cast("int").alias("p")).count().collect()  # at most self.parts rows
        n, touched = sum(r[1] for r in found), {r[0] for r in found}
        if dry_run or not touched:
            return base, n
        return self._publish(base, self.read(base, touched).filter(~bad), touched), n

    def forget(self, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` versions and the folders that only those used; the folders' names. No writer may be at work."""
        last = self.latest()
        versions = range(max(1, last - keep + 1), last + 1)
        used = {f for v in versions for f in self.folders(v).values()}
        place, files = _files(self.spark, f"{self.path}/data")
        gone = []
        for write in files.listStatus(place) if files.exists(place) else []:
            for part in files.listStatus(write.getPath()):
                name = f"data/{write.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in used:
                    files.delete(part.getPath(), True)
                    gone.append(name)
        for v in range(1, versions.start):
            files.delete(_files(self.spark, f"{self.path}/versions/v{v:09d}.json")[0], False)
        return sorted(gone)
