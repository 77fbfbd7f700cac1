"""Scans that go on past bad rows and tell of them: reports as JSON, ledgers of several sections as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import sweep

#: Beginnings of names that are carved out of a report.
BAND = ("__ehhandler$", "__unwindfunclet$", "__catch$")
REPORT = "name string, functions array<struct<name: string, size: string, fuzzy_match_percent: double>>, _bad string"
WARNING = "path string, at long, text string, reason string"


def freshest(spark: SparkSession, paths: list[str]) -> str:
    """Of the paths that are there the one changed last, of equals the first."""
    path, found = spark._jvm.org.apache.hadoop.fs.Path, []
    for k, p in enumerate(paths):
        fs = path(p).getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path(p)):
            found.append((-fs.getFileStatus(path(p)).getModificationTime(), k, p))
    if not found:
        raise FileNotFoundError(f"no report: none of {', '.join(paths)} is there")
    return min(found)[2]


def scores(spark: SparkSession, paths: list[str], band: tuple[str, ...] = BAND) -> tuple[DataFrame, DataFrame]:
    """Scores (unit, fn, size, pct, carved) of the freshest report, a unit a line of JSON, and warnings of WARNING.

    carved: the name begins like one of the band. A missing size or score is 0. Lines that are no unit are warnings; a line
    holds a unit, so a report of any size is read by many tasks.
    """
    at = freshest(spark, paths)
    lines = spark.read.text(at).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at")).where("trim(text) <> ''")
    parsed = lines.withColumn("u", F.from_json("text", REPORT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.when(F.col("u._bad").isNotNull() | F.col("u").isNull(), "no JSON of a unit").when(F.col("u.name").isNull(), "no name").when(F.col("u.functions").isNull() & F.col("text").contains('"functions"'), "functions are no list")
    told = parsed.withColumn("reason", bad)
    rows = told.where("reason is null").select(F.col("u.name").alias("unit"), F.explode("u.functions").alias("f")).where("f.name is not null")
    carved = F.lit(False)
    for b in band:
        carved = carved | F.col("f.name").startswith(b)
    size = F.coalesce(F.col("f.size").try_cast("long"), F.lit(0))
    return rows.select("unit", F.col("f.name").alias("fn"), size.alias("size"), F.coalesce("f.fuzzy_match_percent", F.lit(0.0)).alias("pct"), carved.alias("carved")), told.where("reason is not null").select("path", "at", "text", "reason")


def in_sections(spark: SparkSession, path: str) -> DataFrame:
    """Lines (path, block, place, text, section) of text files, with the last header before them, `# [name]` and a tab or the end.

    Order within a file is the block's start, then the place in the block; blocks are read by as many tasks, and what
    section one ends in is handed on to the next.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.col("value").alias("text"))
    head = F.regexp_extract("text", r"^# \[([^\]]*)\](?:\t|$)", 1)
    marked = lines.withColumn(sweep.SPACE, F.struct("path")).withColumn(sweep.CELL, F.col("block"))
    told = sweep.last_known(marked, F.when(head != "", head), [F.col("place")], F.struct("block", "place"), "section")
    return sweep.done(told).where(head == "")


LEDGER = ("unit", "fn", "best", "cur", "tries", "fp", "addr", "hist", "state")


def ledger(spark: SparkSession, path: str, section: str = "functions") -> tuple[DataFrame, DataFrame]:
    """Rows (LEDGER) of a section of a ledger, and warnings of WARNING for those skipped.

    Lines without text and comments are none. Six columns must be there; addr, hist (best if it is missing) and state may be.
    Of rows with one key the last in the file counts.
    """
    lines = in_sections(spark, path).where(F.col("section") == section).where("text <> '' and not text like '#%'")
    c = lines.withColumn("c", F.split("text", "\t"))
    given = lambda k: F.nullif(F.get("c", F.lit(k)), F.lit(""))
    number = lambda x: x.try_cast("double")
    address = F.conv(F.regexp_extract(given(6), "^(?:0x)?([0-9a-fA-F]{1,15})$", 1), 16, 10).try_cast("long")
    values: dict[str, Column] = {"best": number(given(2)), "cur": number(given(3)), "tries": given(4).try_cast("long"), "addr": address, "hist": F.coalesce(number(given(7)), number(given(2)))}
    wrong = F.when(F.size("c") < 6, "too few columns")
    for name in ("best", "cur", "tries"):
        wrong = wrong.when(values[name].isNull(), f"{name} is no number")
    wrong = wrong.when(given(6).isNotNull() & (F.regexp_extract(given(6), "^(?:0x)?([0-9a-fA-F]{1,15})$", 1) == ""), "addr is no number").when(given(7).isNotNull() & number(given(7)).isNull(), "hist is no number")
    told = c.withColumn("reason", wrong)
    order = F.struct("path", "block", "place")
    good = told.where("reason is null").select(F.get("c", F.lit(0)).alias("unit"), F.get("c", F.lit(1)).alias("fn"), order.alias("_order"), F.struct(*[values[n].alias(n) for n in ("best", "cur", "tries")], F.get("c", F.lit(5)).alias("fp"), values["addr"].alias("addr"), values["hist"].alias("hist"), F.coalesce(F.get("c", F.lit(8)), F.lit("")).alias("state")).alias("r"))
    rows = good.groupBy("unit", "fn").agg(F.max_by("r", "_order").alias("r")).select("unit", "fn", "r.*")
    return rows, told.where("reason is not null").select("path", F.col("block").alias("at"), "text", "reason")
