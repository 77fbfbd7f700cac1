"""The SQL surface: named tables of one map, queried with parameter markers instead of pasted values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SqlMap:
    """Tables by name; queries name them in braces, so several maps can live in one session."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def register(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def sql(self, text: str, **values) -> DataFrame:
        used = {n: df for n, df in self.tables.items() if "{" + n + "}" in text}
        return self.spark.sql(text, args=values or None, **used)

    def at(self, table: str, key: str, value) -> DataFrame:
        """Rows of a table whose key is the value."""
        return self.tables[table].where(self.tables[table][key] == value)

    def within(self, table: str, key: str, lo, hi) -> DataFrame:
        """Rows of a table with lo <= key < hi."""
        c = self.tables[table][key]
        return self.tables[table].where((c >= lo) & (c < hi))

    def named(self, table: str, column: str, part: str) -> DataFrame:
        """Rows whose column contains the part, whatever its case."""
        return self.tables[table].where(self.tables[table][column].ilike("%" + part.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"))
