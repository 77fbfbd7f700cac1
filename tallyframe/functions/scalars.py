"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_int(text: Column) -> Column:
    """A decimal or 0x number as a long; null if it is neither."""
    t = F.lower(F.trim(text))
    return F.when(t.rlike("^0x[0-9a-f]{1,16}$"), F.conv(F.substring(t, 3, 16), 16, 10).try_cast("decimal(20,0)").try_cast("long")).otherwise(t.try_cast("long"))


def to_hex(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(n)))


def escape(text: Column) -> Column:
    """Backslash, tab, carriage return and line feed as two characters each."""
    for raw, shown in (("\\", "\\\\"), ("\t", "\\t"), ("\r", "\\r"), ("\n", "\\n")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def fingerprint(text: Column) -> Column:
    """The first twelve hexadecimal digits of SHA-1."""
    return F.substring(F.sha1(text), 1, 12)


def first_digits(text: Column) -> Column:
    return F.regexp_extract(text, "[0-9]+", 0)


def wrap16(n: Column) -> Column:
    """As a signed 16-bit number."""
    return F.pmod(n + 32768, F.lit(65536)) - 32768


def truncating_div(a: Column, b: Column) -> Column:
    """Quotient rounded towards zero; null where b is 0."""
    size = F.floor(F.abs(a) / F.nullif(F.abs(b), F.lit(0))).cast("long")
    return size * F.signum(a).cast("long") * F.signum(b).cast("long")


def align(n: Column, to: int) -> Column:
    """The next multiple of a power of two."""
    return (n + (to - 1)).bitwiseAND(F.lit(~(to - 1)).cast("long"))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where whole is."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def begins_with(text: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | text.startswith(p)
    return out


#: What a special name's code stands for, {cls} being its class; any other code is an operator.
SPECIAL = {"0": "{cls}::{cls}", "1": "{cls}::~{cls}", "_7": "{cls}::`vftable'", "_8": "{cls}::`vbtable'", "_G": "{cls}::`vector deleting dtor'", "_E": "{cls}::`scalar deleting dtor'", "_D": "{cls}::`vbase destructor'", "_R": "{cls}::`RTTI'", "_C": "`string'"}
#: A decorated name: the code of a special one, its own identifier, and the chain of what is around it, inside out.
DECORATED = r"(?s)^_?\?(?:\?(_R(?=[0-9])|_.|.))?(?:(?<=_R)[0-9])?@*([^@]+)((?:@(?!@)[^@]*)*)"
#: Classes at the head of a chain, and the function that a chain without them begins with.
CLASSES, FUNCTION = r"^((?:@[A-Za-z_]\w*(?=@|$))*)", r"^@\?[0-9]+\?{0,2}([^@]+)"


def short_name(name: Column) -> Column:
    """The readable name of a decorated one: scope::member, what SPECIAL says, or function::member for what is local to one.

    A plain name loses its underscores in front and what follows an @; what has no identifier stays as it is.
    """
    field = lambda k: F.regexp_extract(name, DECORATED, k)
    text = F.create_map(*[F.lit(x) for pair in SPECIAL.items() for x in pair])
    parts = F.struct(field(1).alias("code"), field(2).alias("own"), F.regexp_extract(field(3), CLASSES, 1).alias("around"), F.regexp_extract(field(3), FUNCTION, 1).alias("function"))

    def read(x: Column) -> Column:
        special = F.replace(F.coalesce(text[x["code"]], F.lit("{cls}::operator")), F.lit("{cls}"), x["own"])
        outside = F.reverse(F.filter(F.split(x["around"], "@"), lambda c: c != ""))
        scope = F.when(x["around"] != "", F.concat(F.array_join(outside, "::"), F.lit("::"))).when(x["function"] != "", F.concat(x["function"], F.lit("::"))).otherwise(F.lit(""))
        return F.when(x["code"] != "", special).otherwise(F.concat(scope, x["own"]))

    said = F.element_at(F.transform(F.array(parts), read), 1)
    undecorated = F.regexp_extract(name, r"^_*([^@]*)", 1)
    return F.when(~name.rlike(r"^_?\?"), F.when(undecorated != "", undecorated).otherwise(name)).when(field(2) == "", F.regexp_replace(name, r"^_(?=\?)", "")).otherwise(said)


def divisor(magic: Column, shift: Column) -> Column:
    """The divisor behind a multiplication by magic and a shift right by 32 + shift; null if none is near.

    In whole numbers: d is the one for which d * magic is nearest to the power of two, and must miss it by less than a
    fiftieth of magic.
    """
    whole = lambda c: c.cast("decimal(28,0)")
    power, m = whole(F.pow(F.lit(2.0), shift + 32)), whole(F.nullif(F.greatest(magic.cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")))
    d = F.call_function("div", power + power + m, m + m)
    return F.when((d >= 2) & (F.abs(power - d * m) * 50 < m), d)


#: Strings and characters in quotes, comments up to their end mark (the second group), and what is between.
CODE = r"""("[^"\\]*+(?:\\[\s\S]?[^"\\]*+)*+"?|'[^'\\]*+(?:\\[\s\S]?[^'\\]*+)*+'?|(//[^\n]*|/(?=\*)[\s\S]*?(?=\*/|\z))|[^"'/]+|/)"""


def blank_comments(code: Column) -> Column:
    """Code of the same length whose comments are spaces but for line feeds and the mark that ends one; quotes are kept."""
    parts, comments = (F.regexp_extract_all(code, F.lit(CODE), F.lit(i)) for i in (1, 2))
    return F.array_join(F.zip_with(parts, comments, lambda p, c: F.when(c != "", F.regexp_replace(p, r"[^\n]", " ")).otherwise(p)), "")


def once(value: Column, use) -> Column:
    """use(value), with the value worked out once, however often it is used and in whatever functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def split_top(text: Column) -> Column:
    """What commas outside of all brackets part, trimmed; nothing after the last one is no part.

    Cut at every comma first; a piece begins a part where the brackets opened and closed before it are as many.
    """
    count = lambda p, marks: F.length(p) - F.length(F.translate(p, marks, ""))
    change = lambda pieces: F.transform(pieces, lambda p: count(p, "(<[") - count(p, ")>]"))
    before = lambda pieces: F.aggregate(change(pieces), F.array(F.lit(0)), lambda depths, x: F.array_append(depths, F.element_at(depths, -1) + x))
    begins = lambda pieces: once(before(pieces), lambda b: F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda k: F.get(b, k) == 0))
    cut = lambda pieces, at: F.transform(at, lambda k, i: F.trim(F.array_join(F.slice(pieces, k + 1, F.coalesce(F.get(at, i + 1), F.size(pieces)) - k), ",")))
    last = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return once(F.split(text, ","), lambda pieces: once(begins(pieces), lambda at: once(cut(pieces, at), last)))


#: Words of a sentence that says both sides agree, that they do not, and that it is about trials.
AGREE = "agree agrees agreed identical exact exactly both same match matches"
DIVERGE = "vs versus against differ differs differing while whereas short only instead prior banked historical recorded fell falls rose raising delta deltas because though although but residue residual extra missing ahead behind cost costs gain gains"
TRIAL = "compile compiles compiled byte-identical byte-identically byte-flat variant variants control controls campaign campaigns island islands trial trials disposable probe probes experiment experiments candidate candidates rejected tested"


def has_word(text: Column, words: str) -> Column:
    return text.rlike(rf"(?i)\b(?:{words.replace(' ', '|')})\b")


def sentences(text: Column) -> Column:
    """Clauses that end with a point or semicolon before a space, a tab or the end; numbers keep their points."""
    return F.filter(F.split(text, r"(?<=[.;])(?=[ \t]|\z)"), lambda s: F.trim(s) != "")


def agreed_counts(text: Column, units: list[str]) -> Column:
    """The distinct (unit, n) for which a sentence says that both sides have n.

    That is "n/n unit", and "n unit" where a sentence speaks of agreement and of no divergence; sentences about trials say
    nothing. Units are matched without regard to case, and are words of letters only.
    """
    one = "|".join(sorted(units, key=len, reverse=True))
    ratio, count = rf"(?i)(?<![\d.])(\d+)\s*/\s*(\d+)\s+({one})\b", rf"(?i)(?<![\d./x])(\d+)\s+(?:ordered\s+)?({one})\b"
    group = lambda s, pattern, k: F.regexp_extract_all(s, F.lit(pattern), F.lit(k))
    said = lambda unit, n: F.struct(F.lower(unit).alias("unit"), n.cast("long").alias("n"))

    def of(s: Column) -> Column:
        sides = F.arrays_zip(group(s, ratio, 1).alias("a"), group(s, ratio, 2).alias("b"), group(s, ratio, 3).alias("unit"))
        equal = F.transform(F.filter(sides, lambda x: x["a"].cast("long") == x["b"].cast("long")), lambda x: said(x["unit"], x["a"]))
        rest = F.regexp_replace(s, ratio, "")
        counts = F.zip_with(group(rest, count, 2), group(rest, count, 1), said)
        none = F.slice(equal, F.lit(1), F.lit(0))
        return F.when(has_word(s, TRIAL), none).otherwise(F.concat(equal, F.when(has_word(s, AGREE) & ~has_word(s, DIVERGE), counts).otherwise(none)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(sentences(text), of))))
