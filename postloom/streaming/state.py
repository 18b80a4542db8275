"""State that grows by changes: a table with one row for each key, in hash buckets, as a base and logs of changes.

A version of the table writes only its changed rows, to a log with a folder for each bucket that they fall in.  A
bucket with more than ``most_logs`` logs is merged into a new base; other buckets keep theirs.  A manifest names each bucket's base
and logs, and is put in place by renaming when all is written; so a reader sees a whole version or the one before, and a version that is
written again starts from the same one before and replaces itself.  Folders that none of the last ``keep`` manifests names are deleted.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """A keyed table in ``folder``, which all executors share; ``schema`` is a DDL string that has ``key``."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str, buckets: int = 256, most_logs: int = 8, keep: int = 3):
        if keep < 2:
            raise ValueError("a version can be written again only while the one before is kept")
        self.spark, self.folder, self.key, self.schema = spark, folder.rstrip("/"), key, schema
        self.buckets, self.most_logs, self.keep = buckets, most_logs, keep
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def bucket(self, column: str) -> F.Column:
        return F.pmod(F.xxhash64(F.col(column)), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame, column: str | None = None) -> list[int]:
        """The buckets that a column's values fall in; at most ``buckets`` numbers come to the driver."""
        return sorted(r[0] for r in rows.select(self.bucket(column or self.key)).distinct().collect())

    def _names(self, folder: str) -> list[str]:
        there = self.path(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(there)] if self.fs.exists(there) else []

    def versions(self, before: int | None = None) -> list[int]:
        """The complete versions that are kept, the newest last."""
        found = [int(m[1]) for m in (re.fullmatch(r"manifest-(\d+)\.json", n) for n in self._names(self.folder)) if m]
        return sorted(v for v in found if before is None or v < before)

    def manifest(self, version: int) -> dict[int, list[str]]:
        """For each bucket its folders: a base, where there is one, and the logs since."""
        text = self.spark.read.text(f"{self.folder}/manifest-{version}.json", wholetext=True).first()[0]
        return {int(b): folders for b, folders in json.loads(text).items()}

    def _rows(self, named: dict[int, list[str]]) -> DataFrame:
        """The latest row of each key in some buckets."""
        paths = [f"{self.folder}/{folder}/bucket={b}" for b, folders in named.items() for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        version = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:base|log)-(\d+)/bucket=\d+/[^/]*$", 1).cast("long")
        rows = self.spark.read.schema(self.schema).parquet(*paths).select("*", version.alias("_version"))
        columns = [c for c in rows.columns if c not in (self.key, "_version")]
        latest = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), "_version").alias("_row"))
        return latest.select(self.key, "_row.*").select(*self.spark.createDataFrame([], self.schema).columns)

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of the newest version, or the newest ``before`` one; of some buckets only, no file of others is opened."""
        known = self.versions(before)
        named = self.manifest(known[-1]) if known else {}
        return self._rows(named if buckets is None else {b: named[b] for b in buckets if b in named})

    def _write(self, rows: DataFrame, name: str) -> list[int]:
        target = f"{self.folder}/{name}"
        rows.withColumn("bucket", self.bucket(self.key)).repartition("bucket").write.mode("overwrite").parquet(target, partitionBy="bucket")
        return [int(n[7:]) for n in self._names(target) if n.startswith("bucket=")]

    def apply(self, changes: DataFrame, version: int) -> None:
        """Write a version: ``changes`` are whole rows, one for each new or changed key."""
        known = self.versions(version)
        named = self.manifest(known[-1]) if known else {}
        columns = self.spark.createDataFrame([], self.schema).columns
        for b in self._write(changes.select(*columns), f"log-{version}"):
            named[b] = [*named.get(b, []), f"log-{version}"]
        full = {b: folders for b, folders in named.items() if len(folders) > self.most_logs + folders[0].startswith("base-")}
        if full:
            for b in self._write(self._rows(full), f"base-{version}"):
                named[b] = [f"base-{version}"]
        self._put(f"manifest-{version}.json", json.dumps({str(b): folders for b, folders in sorted(named.items())}))
        self._prune()

    def _put(self, name: str, text: str) -> None:
        part, whole = self.path(f"{self.folder}/_{name}.part"), self.path(f"{self.folder}/{name}")
        out = self.fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(whole):
            self.fs.delete(whole, False)
        self.fs.rename(part, whole)

    def _prune(self) -> None:
        versions = self.versions()
        for v in versions[: -self.keep]:
            self.fs.delete(self.path(f"{self.folder}/manifest-{v}.json"), False)
        used = {f"{folder}/bucket={b}" for v in versions[-self.keep :] for b, folders in self.manifest(v).items() for folder in folders}
        for folder in self._names(self.folder):
            if re.fullmatch(r"(base|log)-\d+", folder):
                own = [n for n in self._names(f"{self.folder}/{folder}") if n.startswith("bucket=")]
                dead = [n for n in own if f"{folder}/{n}" not in used]
                for n in [""] if len(dead) == len(own) else dead:
                    self.fs.delete(self.path(f"{self.folder}/{folder}/{n}".rstrip("/")), True)
