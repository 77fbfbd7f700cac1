"""Resolution of claims on the rows of a census: one winner a key, the losers kept, and what is wrong as findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.intervals import asof


def rank_of(channel: Column, precedence: Sequence[str]) -> Column:
    """The channel's place in the precedence; null for an unknown one."""
    return F.coalesce(*[F.when(channel == c, F.lit(i)) for i, c in enumerate(precedence)])


def owners(claims: DataFrame) -> DataFrame:
    """claims (key, channel, name, unit, size) with identical ones of several units as one: the first unit owns it, also_units has the rest."""
    one = claims.groupBy("key", "channel", "name").agg(F.min(F.struct("unit", "size")).alias("first"), F.array_sort(F.collect_set("unit")).alias("units"))
    return one.select("key", "channel", "name", F.col("first.unit").alias("unit"), F.col("first.size").alias("size"), F.array_remove("units", F.col("first.unit")).alias("also_units"))


def resolve(census: DataFrame, claims: DataFrame, precedence: Sequence[str], sized: Sequence[str], blanked: Sequence[str] = ()) -> DataFrame:
    """census (key, size) with name, unit, channel, also_units and aliases, the losers as channel:name.

    The winner comes from the channel of highest precedence, then by name. Its size counts if its channel has authority
    over sizes and it is positive and fits; the census size else. A winner of a blanked channel loses its name to the
    aliases. Unclaimed rows have empty strings.
    """
    return bound(census, owners(claims.where(rank_of(F.col("channel"), precedence).isNotNull())), precedence, sized, blanked)


def bound(census: DataFrame, owned: DataFrame, precedence: Sequence[str], sized: Sequence[str], blanked: Sequence[str] = ()) -> DataFrame:
    """As resolve, of claims that have an owner each (see owners)."""
    known = owned.withColumn("rank", rank_of(F.col("channel"), precedence))
    entry = F.struct("rank", "name", "channel", "unit", "size", "also_units")
    per_key = known.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    first = F.col("all")[0]
    told = lambda c: F.concat(c["channel"], F.lit(":"), c["name"])
    losers = F.transform(F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))), told)
    out = census.withColumnRenamed("size", "room").join(per_key, "key", "left")
    is_blank = first["channel"].isin(*blanked) if blanked else F.lit(False)
    fits = first["channel"].isin(*sized) & (first["size"] > 0) & (first["size"] <= F.col("room"))
    some = F.col("all").isNotNull()
    return out.select(
        "key", F.when(some & fits, first["size"]).otherwise(F.col("room")).alias("size"), F.when(some & ~is_blank, first["name"]).otherwise("").alias("name"),
        F.when(some, first["unit"]).otherwise("").alias("unit"), F.when(some, first["channel"]).otherwise("").alias("channel"),
        F.when(some, F.array_join(first["also_units"], ";")).otherwise("").alias("also_units"),
        F.when(some, F.array_join(F.when(is_blank, F.concat(F.array(told(first)), losers)).otherwise(losers), "|")).otherwise("").alias("aliases"),
    )


def orphans(census: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims on no row of the census."""
    return claims.join(census, "key", "left_anti")


def oversized(census: DataFrame, claims: DataFrame, sized: Sequence[str]) -> DataFrame:
    """Claims of channels with authority over sizes that exceed the census row."""
    return claims.where(F.col("channel").isin(*sized)).join(census.withColumnRenamed("size", "room"), "key").where("size > room")


def shared_names(rows: DataFrame, name: str, key: str, exempt: str | None = None) -> DataFrame:
    """Names bound to several keys (name, n_keys, keys joined by ;), but for those that match the exempt pattern."""
    rows = rows.where(~F.col(name).rlike(exempt)) if exempt else rows
    out = rows.groupBy(F.col(name).alias("name")).agg(F.count_distinct(key).alias("n_keys"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    return out.where("n_keys > 1")


def active(claims: DataFrame, weak: str) -> DataFrame:
    """Claims but those of the weak channel that have a low confidence, in any case of letters; an unknown one stays."""
    return claims.where(~F.coalesce((F.col("channel") == weak) & (F.upper("confidence") == "LOW"), F.lit(False)))


def violations(census: DataFrame, claims: DataFrame, precedence: Sequence[str], sized: Sequence[str], unique: Sequence[str]) -> DataFrame:
    """(kind, key, channel, name): claims of unknown channels, claims on no row of the census, claims that exceed their
    row, and names of the unique channels on several keys, with the first of these."""
    known = rank_of(F.col("channel"), precedence).isNotNull()
    row = lambda df, kind: df.select(F.lit(kind).alias("kind"), "key", "channel", "name")
    several = claims.where(F.col("channel").isin(*unique)).groupBy("channel", "name").agg(F.min("key").alias("key"), F.max("key").alias("last")).where("key <> last")
    out = row(claims.where(~known), "UNKNOWN-CHANNEL").unionByName(row(orphans(census, claims.where(known)), "ORPHAN"))
    return out.unionByName(row(oversized(census, claims, sized), "OVERSIZED")).unionByName(row(several, "TWO-KEYS"))


def emitting(claims: DataFrame, emitted: DataFrame) -> DataFrame:
    """claims without those of units that do not emit the name, where several units claim it at one key and some unit does.

    emitted: (unit, name). Claims that one unit makes, or that no unit emits, stay.
    """
    marked = claims.join(emitted.select("unit", "name", F.lit(True).alias("_emits")).distinct(), ["unit", "name"], "left").withColumn("_emits", F.coalesce("_emits", F.lit(False)))
    groups = marked.groupBy("key", "name").agg(F.count_distinct("unit").alias("_units"), F.max("_emits").alias("_some"))
    return marked.join(groups, ["key", "name"]).where("_emits or _units = 1 or not _some").select(*claims.columns)


def banded(owned: DataFrame, bands: DataFrame, place: str, width: int) -> DataFrame:
    """owned claims of several units, the one whose band (unit, lo, hi; none overlaps another) holds their place owning them, if it is one of these."""
    at = owned.where(F.size("also_units") > 0).select("key", F.col(place).alias("lo")).distinct()
    held = asof(at, bands.select("lo", "hi", "unit"), [], "lo", ["hi", "unit"], width=width).where("lo < anchor_hi").select("key", F.col("anchor_unit").alias("_band"))
    j = owned.join(held, "key", "left").withColumn("_moves", F.coalesce(F.array_contains("also_units", F.col("_band")), F.lit(False)))
    moves = F.col("_moves")
    also = F.when(moves, F.array_sort(F.array_append(F.array_remove("also_units", F.col("_band")), F.col("unit")))).otherwise(F.col("also_units"))
    return j.withColumn("also_units", also).withColumn("unit", F.when(moves, F.col("_band")).otherwise(F.col("unit"))).drop("_band", "_moves")


def model(census: DataFrame, claims: DataFrame, emitted: DataFrame, bands: DataFrame, admitted: dict[str, Sequence[str]], precedence: Sequence[str], sized: Sequence[str], blanked: Sequence[str], width: int) -> tuple[DataFrame, DataFrame]:
    """Bindings (key, kind, size, name, unit, channel, also_units, aliases) of a census (key, size, kind), and violations (kind, key, channel, name).

    claims: (key, channel, name, unit, size). Of the units that claim a name at a key only those that emit it count, if
    any does; the unit whose band holds the key owns the claim, else the first by name; then resolve() chooses. A size is
    that of the claim that owns it. Violations: KIND, a winner of a channel that is not admitted on rows of the kind
    (admitted: kinds by channel; a channel without an entry is admitted on all); NOT-EMITTED, a name that several units
    claim at a key and none emits; CROSSES, a winner with authority that is larger than its row; UNKNOWN-CHANNEL, ORPHAN.
    """
    known = claims.where(rank_of(F.col("channel"), precedence).isNotNull())
    kept = emitting(known, emitted)
    owned = banded(owners(kept), bands, "key", width)
    # The size is that of the owner's own claim.
    sizes = kept.groupBy("key", "channel", "name", "unit").agg(F.min("size").alias("_size"))
    owned = owned.join(sizes, ["key", "channel", "name", "unit"], "left").withColumn("size", F.coalesce("_size", "size")).drop("_size")
    out = bound(census.select("key", "size"), owned, precedence, sized, blanked).join(census.select("key", "kind"), "key")
    first = owned.join(out.where("channel <> ''").select("key", "channel"), ["key", "channel"]).groupBy("key", "channel").agg(F.min(F.struct("name", "size")).alias("w")).select("key", "channel", "w.*")
    win = first.join(census.select("key", "kind", F.col("size").alias("room")), "key")
    ok = F.lit(True)
    for channel, kinds in admitted.items():
        ok = F.when(F.col("channel") == channel, F.col("kind").isin(*kinds)).otherwise(ok)
    row = lambda df, kind: df.select(F.lit(kind).alias("violation"), "key", "channel", "name")
    several = known.groupBy("key", "channel", "name").agg(F.count_distinct("unit").alias("n")).where("n > 1")
    silent = several.join(known.join(emitted, ["unit", "name"], "left_semi").select("key", "name").distinct(), ["key", "name"], "left_anti")
    found = row(win.where(~ok), "KIND").unionByName(row(silent, "NOT-EMITTED")).unionByName(row(win.where(F.col("channel").isin(*sized) & (F.col("size") > F.col("room"))), "CROSSES"))
    strange = claims.where(rank_of(F.col("channel"), precedence).isNull())
    found = found.unionByName(row(strange, "UNKNOWN-CHANNEL")).unionByName(row(orphans(census, known), "ORPHAN"))
    return out.select("key", "kind", "size", "name", "unit", "channel", "also_units", "aliases"), found
