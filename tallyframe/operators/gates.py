"""Gates: named checks that return findings; one that audited nothing fails too."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = ("fast", "normal", "full")
FINDING = "gate string, category string, key string, detail string"


@dataclass
class Gate:
    """audit() returns (rows audited, findings with category, key and detail)."""

    name: str
    tier: str
    audit: Callable[[], tuple[DataFrame, DataFrame]]


@dataclass
class Registry:
    gates: dict[str, Gate] = field(default_factory=dict)

    def add(self, name: str, tier: str, audit: Callable[[], tuple[DataFrame, DataFrame]]) -> None:
        if tier not in TIERS or name in self.gates:
            raise ValueError(f"gate {name}: unknown tier or taken name")
        self.gates[name] = Gate(name, tier, audit)

    def findings(self, tier: str) -> DataFrame | None:
        """All findings (gate, category, key, detail) of the tier and those below it."""
        out = None
        for g in self.gates.values():
            if TIERS.index(g.tier) > TIERS.index(tier):
                continue
            rows, found = g.audit()
            empty = rows.groupBy().agg(F.count("*").alias("n")).where("n = 0").select(F.lit(g.name).alias("gate"), F.lit("VACUOUS").alias("category"), F.lit("").alias("key"), F.lit("no row was audited").alias("detail"))
            found = found.select(F.lit(g.name).alias("gate"), "category", F.col("key").cast("string").alias("key"), "detail").unionByName(empty)
            out = found if out is None else out.unionByName(found)
        return out


def outside_domain(rows: DataFrame, key: str, column: str, domain: list[str]) -> DataFrame:
    """Findings for values outside a closed set; a null value is one."""
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(*domain)).select(F.lit("DOMAIN").alias("category"), F.col(key).cast("string").alias("key"), F.concat(F.lit(f"{column}="), F.coalesce(F.col(column).cast("string"), F.lit("null"))).alias("detail"))


def above_floor(metrics: DataFrame, floors: DataFrame) -> DataFrame:
    """Findings for metrics (metric, n) over their floor (metric, floor), or without one."""
    j = metrics.join(floors, "metric", "left").where("floor is null or n > floor")
    return j.select(F.when(F.col("floor").isNull(), "NO-FLOOR").otherwise("ABOVE").alias("category"), F.col("metric").alias("key"), F.concat_ws(" over ", F.col("n").cast("string"), F.col("floor").cast("string")).alias("detail"))


def not_in(rows: DataFrame, known: DataFrame, key: str, category: str) -> DataFrame:
    """Findings for rows whose key the known rows lack."""
    return rows.join(known, key, "left_anti").select(F.lit(category).alias("category"), F.col(key).cast("string").alias("key"), F.lit("").alias("detail"))
