"""Tracked text tables: banner lines with #, a header, tab-separated rows without quoting or escapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.sources import versions


def read(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """Rows under an explicit schema; a row with another number of fields, or a bad value, fails the read."""
    return spark.read.schema(schema).option("sep", "\t").option("header", header).option("comment", "#").option("quote", "").option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def read_units(spark: SparkSession, folder: str, schema: T.StructType | str) -> DataFrame:
    """All tables of a folder with the file's stem as unit."""
    return read(spark, f"{folder}/*.tsv", schema).withColumn("unit", F.regexp_extract(F.col("_metadata.file_name"), r"([^/]*)\.tsv$", 1))


def differs(old: DataFrame, new: DataFrame) -> bool:
    """Whether the tables differ in columns or as multisets of rows, by a digest of each: one scan, no shuffle of rows."""
    columns = sorted(old.columns)
    return columns != sorted(new.columns) or set_digest(old, columns) != set_digest(new, columns)


def write_if_changed(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Publish df as the table's next version only where the newest one differs; versions.read() reads it."""
    old = versions.read(spark, path)
    if old is not None and not differs(old, df):
        return False
    versions.publish(spark, df, path)
    return True


def set_digest(df: DataFrame, columns: list[str]) -> str:
    """A digest of a table that does not depend on the order of its rows, summed without gathering them."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")) for i in range(8)]
    total = df.agg(*[p.alias(f"p{i}") for i, p in enumerate(parts)], F.count("*").alias("n")).first()
    return ":".join(str(x or 0) for x in total)
