"""Quality rules with DataFrame functions only: divergence of a document from its language's references.

References are gathered over all documents: for each value of lang (null is one of its own) the histogram of
character classes, and the COMMON most frequent words with their shares of all words. A document is compared to
its language's two references by Jensen-Shannon distance (base 2, 0 to 1). It fails if the distance of the character
classes is over MAX_CLASS, given MIN_CHARS characters in it, or that of the words over MAX_WORDS, given MIN_WORDS words.
Shorter documents aren't held against a histogram they are too short for.

Everything but the references is computed in the row, from arrays of its own words and lines; no row is spread and
gathered again, so neither hot sources nor groups of copies matter.

Edge cases: a null or empty text has no words and fails the base rule; a text of any length is taken whole; repeated
rows each get their verdict; further columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.llm import common

#: Words of a reference, and the characters that stand for them in a document's code.
COMMON, CODES = 16, "abcdefghijklmnop"
MIN_CHARS, MIN_WORDS = 100, 50
MAX_CLASS, MAX_WORDS = 0.33, 0.55
#: Character classes, as patterns of what is not in them. Lower-case letters, white space and all other characters are
#: classes too; these patterns are looked for in what lower-case letters leave of a text.
CLASSES = {"upper": r"[^A-Z]+", "digit": r"[^0-9]+", "mark": r"[^.,;:!?'\"()\-]+", "symbol": r"[^#*$%&|<>@=+/\\_~^{}\[\]`]+"}
SYMBOLS = r"[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def window_hashes(d: DataFrame) -> DataFrame:
    """d with quick, the hashes of all windows of five words: those of two, four and five words, each from two of the step before."""
    n = F.size("words")

    def step(left: str, right: str, skip: int, m: Column) -> Column:
        joined = F.zip_with(F.slice(left, F.lit(1), m), F.slice(right, F.lit(skip + 1), m), lambda a, b: F.xxhash64(a, b))
        return F.when(n >= 5, joined).otherwise(F.array().cast("array<bigint>"))

    # A column for each step: one that is used twice is then computed once.
    d = d.withColumn("one", F.transform("words", lambda w: F.xxhash64(w))).withColumn("two", step("one", "one", 1, n - 1)).withColumn("four", step("two", "two", 2, n - 3))
    return d.withColumn("quick", step("four", "one", 4, n - 4)).drop("one", "two", "four")


def base(docs: DataFrame) -> DataFrame:
    """docs (doc_id, lang, text) with words, the counts of the contract, class_counts and base_failed."""
    d = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("words", words_of(F.col("text"))).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("rare", F.regexp_replace("text", "[a-z]+", ""))
    starts = F.when(F.size("words") >= 5, F.sequence(F.lit(0), F.size("words") - 5)).otherwise(F.array().cast("array<int>"))
    exact = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get("words", i + j) for j in range(5)]))
    d = d.withColumn("n_words", F.size("words").cast("long")).withColumn("word_chars", F.length(F.array_join("words", "")).cast("long")).withColumn("n_chars", F.length("text").cast("long"))
    d = d.withColumn("n_symbols", F.length(F.regexp_replace("rare", SYMBOLS, "")).cast("long"))
    counted = [F.length(F.regexp_replace("rare", p, "")).cast("long") for p in CLASSES.values()] + [F.col("n_chars") - F.length("rare"), F.col("n_chars") - F.col("word_chars")]
    d = d.withColumn("counted", F.array(*counted)).drop("rare")
    d = d.withColumn("class_counts", F.concat("counted", F.array(F.col("n_chars") - F.aggregate("counted", F.lit(0).cast("long"), lambda a, v: a + v)))).drop("counted")
    d = d.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    # Most texts repeat no window; only where the hashes are not all different are the windows themselves compared.
    d = window_hashes(d).withColumn("some", F.size("quick") > F.size(F.array_distinct("quick"))).drop("quick")
    sorted_windows = F.when(F.col("some"), F.array_sort(F.zip_with(exact, starts, lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    d = d.withColumn("windows", sorted_windows)
    at = lambda i: F.get(F.col("windows"), i)["w"]
    twice = F.transform("windows", lambda x, i: F.when((at(i - 1) == x["w"]) | (at(i + 1) == x["w"]), x["i"]))
    d = d.withColumn("hits", F.array_sort(F.array_compact(twice))).drop("windows")
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + 5 - F.greatest(i, a["end"])).alias("n"), (i + 5).alias("end")),
    )["n"]
    d = d.withColumn("n_repeat_words", F.coalesce(F.when(F.size(F.coalesce("hits", F.array().cast("array<int>"))) > 0, covered), F.lit(0)).cast("long")).drop("hits", "some")
    return d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares; each is made to sum to 1, an empty one is at distance 0."""
    add = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    part = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    scaled = lambda x: F.transform(x, lambda v: v / add(x))
    terms = F.zip_with(scaled(p), scaled(q), lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.when((add(p) > 0) & (add(q) > 0), F.sqrt(F.greatest(F.lit(0.0), add(terms) / 2))).otherwise(F.lit(0.0))


KEYS = ["ref_lang", "ref_null"]


def of_lang(df: DataFrame) -> DataFrame:
    return df.withColumn("ref_lang", F.coalesce("lang", F.lit(""))).withColumn("ref_null", F.col("lang").isNull())


def common_words(docs: DataFrame) -> DataFrame:
    """For each lang its COMMON most frequent words and their counts (common, n)."""
    # Letters only, counted in each task before the shuffle.
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")
    all_ = of_lang(docs).select(*KEYS, F.explode(words).alias("w")).where("w <> ''")
    # The rank is limited in each task before the shuffle, so that a group's list is of COMMON words.
    ranked = all_.groupBy(*KEYS, "w").count().withColumn("place", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("count"), "w")))
    top = ranked.where(F.col("place") <= COMMON).groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("place", "w", "count"))).alias("top"))
    return top.select(*KEYS, F.col("top.w").alias("common"), F.col("top.count").alias("n"))


#: References of so many languages at most, under a kilobyte each, are sent to every task; more are joined by shuffle.
BROADCAST_LANGS = 10_000


def sent(refs: DataFrame) -> DataFrame:
    refs = common.cut(refs)
    return F.broadcast(refs) if refs.count() <= BROADCAST_LANGS else refs


def measured(docs: DataFrame, top: DataFrame) -> DataFrame:
    """Per document the counts of base() and how often each of its language's common words is in it (seen, the rest last)."""
    d = of_lang(base(docs).drop("words")).join(top.drop("n"), KEYS, "left").withColumn("common", F.coalesce("common", F.array().cast("array<string>")))
    places = F.transform(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.array_position("common", w))
    d = d.withColumn("code", F.array_join(F.transform(F.filter(places, lambda i: i > 0), lambda i: F.substring(F.lit(CODES), i.cast("int"), 1)), "")).drop("text")
    seen = F.transform(F.sequence(F.lit(1), F.greatest(F.size("common"), F.lit(1))), lambda i: (F.length("code") - F.length(F.replace("code", F.substring(F.lit(CODES), i, 1), F.lit("")))).cast("long"))
    others = F.greatest(F.lit(0).cast("long"), F.col("n_words") - F.length("code"))
    return d.withColumn("seen", F.concat(F.slice(seen, F.lit(1), F.size("common")), F.array(others))).drop("code", "common", "lang")


def references(told: DataFrame, top: DataFrame) -> DataFrame:
    """For each lang: classes (counts of each character class) and shares (counts of its common words, the rest last)."""
    k = len(CLASSES) + 3
    sums = told.groupBy(*KEYS).agg(*[F.sum(F.get("class_counts", F.lit(i))).alias(f"c{i}") for i in range(k)], F.sum("n_words").alias("total"))
    joined = sums.join(top.drop("common"), KEYS, "left").withColumn("n", F.coalesce("n", F.array().cast("array<bigint>")))
    known = F.aggregate("n", F.lit(0).cast("long"), lambda a, v: a + v)
    return joined.select(*KEYS, F.array(*[F.col(f"c{i}") for i in range(k)]).alias("classes"), F.concat("n", F.array(F.greatest(F.lit(0).cast("long"), F.col("total") - known))).alias("shares"))


def judge(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts and base_failed of base(), class_distance, word_distance and kept."""
    top = sent(common_words(docs))
    told = common.stash(measured(docs, top))
    d = told.join(sent(references(told, top)), KEYS, "left")
    real = lambda c: F.transform(c, lambda v: v.cast("double"))
    d = d.withColumn("class_distance", distance(real("class_counts"), real("classes"))).withColumn("word_distance", distance(real("seen"), real("shares")))
    far = ((F.col("n_chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS)) | ((F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORDS))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"))
