"""Tables in versions: what is there stays whole until its successor is, and derived rows follow only sources that changed.

A table is a folder of versions; the newest complete one counts. A version is written under a name that no reader looks at
and takes its place by a rename, so a crash at any point leaves the last version as it was. Old versions go afterwards.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = re.compile(r"v(\d{10})$")


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(at).getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, at: str) -> list[int]:
    """Numbers of the complete versions of a table, rising."""
    path, fs = _files(spark, at)
    if not fs.exists(path(at)):
        return []
    found = (VERSION.search(x.getPath().getName()) for x in fs.listStatus(path(at)))
    return sorted(int(m[1]) for m in found if m)


def folder(at: str, version: int) -> str:
    return f"{at.rstrip('/')}/v{version:010d}"


def read(spark: SparkSession, at: str) -> DataFrame | None:
    """The newest version, or None."""
    have = versions(spark, at)
    return spark.read.parquet(folder(at, have[-1])) if have else None


def publish(spark: SparkSession, df: DataFrame, at: str, keep: int = 1) -> int:
    """Write df as the next version and drop all but the newest `keep`; the number of the version."""
    path, fs = _files(spark, at)
    have = versions(spark, at)
    number = (have[-1] if have else 0) + 1
    fresh = f"{at.rstrip('/')}/_{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    if not fs.rename(path(fresh), path(folder(at, number))):
        fs.delete(path(fresh), True)
        raise RuntimeError(f"version {number} of {at} was written by another")
    for old in [*have, number][: -keep or None]:
        fs.delete(path(folder(at, old)), True)
    return number


def sources(spark: SparkSession, files: str) -> DataFrame:
    """(path, length, changed) of the files, without their contents."""
    return spark.read.format("binaryFile").load(files).select("path", "length", F.col("modificationTime").alias("changed"))


class Harvest:
    """Rows derived from files, those of a file again only when its contents have changed.

    `at` holds the manifest, a table in versions of (path, length, changed, digest, part), and parts: a folder for each run
    that had something to derive, with the rows of the files that had changed by then, partitioned by `unit`, a digest
    of the path. A run lists the files, reads those whose length or time is not the manifest's, derives rows from those
    whose contents are not, writes them as one new part, and then publishes the manifest, which is what makes the part
    count. A file that is gone leaves the manifest. Readers take from each part the files that the manifest has there.
    """

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at.rstrip("/")

    def manifest(self) -> DataFrame | None:
        return read(self.spark, f"{self.at}/manifest")

    def run(self, files: str, derive: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Bring the harvest up to date; derive takes (path, content) and returns rows with path. The paths derived anew."""
        now, known = sources(self.spark, files), self.manifest()
        old = known if known is not None else now.select("*", F.lit("").alias("digest"), F.lit("").alias("part")).where("false")
        same = ["path", "length", "changed"]
        touched = [r["path"] for r in now.join(old, same, "left_anti").select("path").collect()]
        kept = now.select(*same).join(old, same).select(*same, "digest", "part")
        if not touched and known is not None and kept.count() == known.count():
            return []
        part, changed = uuid.uuid4().hex, []
        if touched:
            content = self.spark.read.format("binaryFile").load([_escaped(p) for p in touched])
            read_ = content.select("path", "length", F.col("modificationTime").alias("changed"), F.sha2("content", 256).alias("digest")).join(old.select("path", F.col("digest").alias("_old"), F.col("part").alias("_part")), "path", "left")
            told = read_.select(*same, "digest", F.when(F.col("digest") == F.col("_old"), F.col("_part")).otherwise(F.lit(part)).alias("part")).collect()
            changed = [r["path"] for r in told if r["part"] == part]
            kept = kept.unionByName(self.spark.createDataFrame(told, kept.schema))
            if changed:
                rows = derive(self.spark.read.format("binaryFile").load([_escaped(p) for p in changed]).select("path", "content"))
                rows.withColumn("unit", F.sha1("path")).write.partitionBy("unit").parquet(f"{self.at}/parts/part={part}")
        publish(self.spark, kept.coalesce(1), f"{self.at}/manifest")
        return sorted(changed)

    def rows(self) -> DataFrame | None:
        """All rows that count, from the folders of their files alone."""
        have = self.manifest()
        if have is None:
            return None
        live = [f"{self.at}/parts/part={r['part']}/unit={r['unit']}" for r in have.select("part", F.sha1("path").alias("unit")).collect()]
        path, fs = _files(self.spark, self.at)
        live = [x for x in live if fs.exists(path(x))]  # a file may give no rows
        return self.spark.read.option("basePath", f"{self.at}/parts").parquet(*live).drop("part", "unit") if live else None


def _escaped(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
