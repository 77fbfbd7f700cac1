"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(column: str) -> Column:
    """Days since 1992-01-01 of a timestamp without time zone: an address on the time line."""
    return F.datediff(F.col(column).cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
