"""Decorated names: their parts, the storage a code stands for, spellings without what differs from build to build, and the stack their parameters take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.scalars import once, split_top

#: Letters after the qualified name, by what they say of a function.
STORAGE = {"virtual": "EFMNUV", "virtual-thunk": "GHOPWX", "non-virtual": "ABIJQR", "static": "CDKLST", "free function": "YZ"}
#: Counters of a build within a name, and the number of a local scope; a name that is a counter alone is none.
COUNTER, SCOPE = r"(?<=[\s\S])\$S[0-9]+(?=@|\z)", r"@\?(?:[0-9]|[A-P]+@)\?\?"
#: Types that take four or eight bytes, after class, struct, union, enum, const and volatile.
FOUR = r"^(?:(?:signed |unsigned )?(?:char|short|int|long|__int32)|float|bool|wchar_t|void)$"
EIGHT = r"^(?:double|long double|(?:unsigned )?__int64)$"
FUNCTION_POINTER, MEMBER_POINTER = r"\(\s*__(?:cdecl|stdcall|thiscall|fastcall)\s*\*\s*\)", r"::\s*\*"


def storage(name: Column) -> Column:
    """What the letter after a decorated name's scopes says: a key of STORAGE, `unknown`, or null for a plain name."""
    code = F.regexp_extract(name, r"^_?\?[\s\S]*?@@([A-Z0-9])", 1)
    out = F.lit("unknown")
    for kind, letters in STORAGE.items():
        out = F.when(code.rlike(f"^[{letters}]$"), kind).otherwise(out)
    return F.when(name.rlike(r"^_?\?"), out)


def masked(name: Column) -> Column:
    """The name with every counter as $S and every local scope as ?1."""
    return F.regexp_replace(F.regexp_replace(name, COUNTER, r"\$S"), SCOPE, "@?1??")


def volatile(name: Column) -> Column:
    """Whether the name says something that differs from build to build."""
    return masked(name) != name


def spelled(name: Column, internal: Column | None = None) -> Column:
    """The name as an object has it: an underscore in front of a plain one, arrays' storage as P, counters and scopes masked.

    internal: data known in one unit only, which has an underscore in front whatever it is called, and a counter behind.
    """
    told = F.regexp_replace(name, r"@@([0-9])Q", "@@$1P")
    told = F.when(told.startswith("?"), told).otherwise(F.concat(F.lit("_"), told))
    if internal is not None:
        kept = F.when(told.startswith("_"), told).otherwise(F.concat(F.lit("_"), told))
        told = F.when(internal, F.concat(kept, F.lit("$S"))).otherwise(told)
    return masked(told)


def distinct_name(name: Column, address: Column) -> Column:
    """A masked name with its address in the place of its counter, null if it has no counter at its end."""
    return F.when(name.endswith("$S"), F.concat(name, address.cast("string")))


def parameter_bytes(parameters: Column) -> Column:
    """(known, objects, blind) of a parameter list without its brackets.

    known: bytes of parameters whose size is certain, four or eight each; objects: parameters passed whole, of four bytes
    at least each; blind: why the sum may be more, of several reasons the last: varargs, which end the list,
    member-pointer or object, else empty. A null list is unknown as a whole: no-parameters.
    """
    base = lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"^(?:class|struct|union|enum) ", ""), r"\b(?:const|volatile)\b", ""))
    pointer = lambda p: p.rlike(r"[*&]$") | p.rlike(FUNCTION_POINTER)
    size = lambda p: F.when(pointer(p), 4).when(p.rlike(MEMBER_POINTER), -1).when(p.startswith("enum "), 4).when(base(p).rlike(EIGHT), 8).when(base(p).rlike(FOUR), 4).otherwise(-2)
    whole = split_top(F.when(F.trim(parameters).isin("void", ""), F.lit("")).otherwise(parameters))

    def summed(parts: Column, dots: Column) -> Column:
        return once(F.transform(F.when(dots > 0, F.slice(parts, F.lit(1), dots - 1)).otherwise(parts), size), lambda sizes: told(sizes, dots))

    def told(sizes: Column, dots: Column) -> Column:
        # Sizes below zero are no sizes but reasons.
        reasons = F.filter(sizes, lambda s: s < 0)
        blind = F.when(dots > 0, "varargs").when(F.size(reasons) == 0, "").when(F.element_at(reasons, -1) == -1, "member-pointer").otherwise("object")
        known = F.aggregate(F.filter(sizes, lambda s: s > 0), F.lit(0), lambda a, s: a + s)
        return F.struct(known.alias("known"), F.size(reasons).alias("objects"), blind.alias("blind"))

    none = F.struct(F.lit(0).alias("known"), F.lit(0).alias("objects"), F.lit("no-parameters").alias("blind"))
    given = once(whole, lambda parts: once(F.array_position(parts, "...").cast("int"), lambda dots: summed(parts, dots)))
    return F.when(parameters.isNull(), none).otherwise(given)
