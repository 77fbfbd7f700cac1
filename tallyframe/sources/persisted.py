"""A map that is kept: tables in buckets by key, sorted within them, so that joins and look-ups by key move no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyframe.plans.sql_surface import SqlMap

#: Tables of the map and the column each is bucketed by; what refers to functions is by function, to data by address.
KEYS = {"functions": "fn", "sites": "fn", "accesses": "fn", "data": "addr", "ranges": "addr"}


def persist(spark: SparkSession, tables: dict[str, DataFrame], at: str, name: str, buckets: int, keys: dict[str, str] | None = None, order: dict[str, list[str]] | None = None) -> SqlMap:
    """Write tables under `at` in so many buckets by key, sorted by it and then by order, and open them as a map.

    Tables of the session named {name}_{table} stand for them. Buckets are one for all tables, so that those of one key
    lie side by side; a table that is there is replaced.
    """
    keys, order = keys or KEYS, order or {}
    out = SqlMap(spark)
    for t, df in tables.items():
        by = [keys[t], *order.get(t, [])]
        # One task writes a bucket, so that a bucket is one file and its order holds.
        df.repartition(buckets, keys[t]).write.mode("overwrite").option("path", f"{at.rstrip('/')}/{t}").bucketBy(buckets, keys[t]).sortBy(*by).saveAsTable(f"{name}_{t}")
        out.register(t, spark.table(f"{name}_{t}"))
    return out
