"""Licence scans by an exact set-similarity join of text blocks with templates, with DataFrame functions only.

Templates are sets of words. A block of the class c is a window of 2 * c words that begins at a multiple of c; a template
is looked for in blocks of the smallest class (a power of two) that is not below its number of words, so that every
passage of its length lies within one block. A block meets a template if it holds at least CONTAINMENT of its words.

The join is complete. Words of templates are ordered by how many documents have them, rarest first. A template that needs
`need` of its `size` words shares one of its first size - need + 1 with every block that meets it (prefix filter); a block
needs as many words of templates (length filter); where the words at places i and j agree, those after them must suffice
(positional filter). What passes is counted in full. Documents without any word of a prefix are not cut into blocks.

Places of fixed phrases are found beside it; both give labels, and the score is 1 where a phrase stands, else the largest
share of a template that a block holds, if it meets the template, else 0.

Edge cases: a null or empty text has no words, no labels and the score 0; texts of any length are taken whole, in blocks;
repeated rows, and rows with one or no doc_id, each get their own result; templates that tie all give their labels;
further columns are ignored; an empty table gives an empty table, and without templates the phrases remain.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import common, url_filter

#: Share of a template's words that a block must hold. Short notices differ in a word or two, so it is high.
CONTAINMENT = 0.9
#: Templates go to all tasks; their words are bounded.
MOST_WORDS = 20_000
#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices of well-known licences and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KELVIN, KAPPA = "\u212a", "\u03ba"


def words_of(text: Column) -> Column:
    """Runs of digits, letters and characters beyond ASCII, letters in lower case.

    The Kelvin sign is the only character beyond ASCII whose lower case is within it; it is set aside first.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(KAPPA)))
    return F.array_remove(F.split(plain, BETWEEN), "")


def strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def starts(phrase: str) -> Column:
    """Where the phrase's words stand consecutively in `words`, from 0."""
    first, *rest = phrase.split()
    here = lambda w, i: reduce(lambda a, x: a & (F.get("words", i + 1 + x[0]) == x[1]), enumerate(rest), w == first)
    found = F.array_compact(F.transform("words", lambda w, i: F.when(here(w, i), i)))
    possible = reduce(lambda a, w: a & F.array_contains("words", w), rest, F.array_contains("words", first))
    return F.when(possible, found).otherwise(F.array().cast("array<int>"))


class Templates:
    """Templates ordered by the counts of their words; `index` has a row for each word of a prefix."""

    def __init__(self, templates: list[tuple[str, list[str]]], counts: dict[str, int], share: float):
        self.order = sorted({w for _, t in templates for w in t}, key=lambda w: (counts.get(w, 0), w))
        rank = {w: i for i, w in enumerate(self.order)}
        self.index, self.classes = [], {}
        for k, (label, told) in enumerate(templates):
            words = sorted(set(told), key=rank.get)
            need = max(1, math.ceil(round(share * len(words), 9)))
            c = 1 << (len(told) - 1).bit_length()
            prefix = words[: len(words) - need + 1]
            known, first, least = self.classes.get(c, (set(), set(), need))
            self.classes[c] = (known | set(words), first | set(prefix), min(least, need))
            self.index += [(c, w, k, label, i, len(words), need, words) for i, w in enumerate(prefix)]

    SCHEMA = "class int, token string, template int, label string, i int, size int, need int, wanted array<string>"

    def blocks(self) -> Column:
        """Of `words`: an array of the blocks that pass the prefix and length filters (class, known, their words of templates)."""
        def of(c: int, known: Column, first: Column, least: int) -> Column:
            begins = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("words") / c).cast("int") - 2))
            sets = F.transform(begins, lambda k: F.array_intersect(F.slice("words", k * c + 1, 2 * c), known))
            kept = F.filter(sets, lambda s: (F.size(s) >= least) & F.arrays_overlap(s, first))
            return F.transform(kept, lambda s: F.struct(F.lit(c).alias("class"), s.alias("known")))

        out = [of(c, strings(sorted(known)), strings(sorted(first)), least) for c, (known, first, least) in sorted(self.classes.items())]
        return F.concat(*out)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, share: float = CONTAINMENT) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The labels are arrays here, sorted and distinct.
    """
    spark = docs.sparkSession
    told = [(label, w) for label, text in templates if (w := plain_words(text))]
    if sum(len(w) for _, w in told) > MOST_WORDS:
        raise ValueError(f"templates have more than {MOST_WORDS} words")
    d = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    vocabulary = sorted({w for _, t in told for w in t})
    counts = {r["w"]: r["count"] for r in d.select(F.explode(F.array_intersect("words", strings(vocabulary))).alias("w")).groupBy("w").count().collect()} if told else {}
    known = Templates(told, counts, share)
    for k, phrase in enumerate(phrases):
        d = d.withColumn(f"at{k}", starts(phrase))
    places = F.concat(F.array().cast("array<int>"), *[F.col(f"at{k}") for k in range(len(phrases))])
    base = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, label in enumerate(phrases.values())]))
    first = strings(sorted({x[1] for x in known.index}))
    facts = d.withColumn("places", places).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"), F.array_sort(F.array_distinct(base)).alias("base_labels"),
        F.when(F.arrays_overlap("words", first), F.col("words")).alias("words"),
    )
    facts = common.stash(facts)
    narrow = facts.drop("words")
    if not told:
        return narrow.select(*narrow.columns[1:], F.col("base_labels").alias("labels"), F.least("n_base", F.lit(1)).cast("double").alias("score"))
    index = F.broadcast(spark.createDataFrame(known.index, Templates.SCHEMA))  # bounded by MOST_WORDS
    least = F.create_map(*[x for c, v in known.classes.items() for x in (F.lit(c), F.lit(v[2]))])
    blocks = facts.where("words is not null").select("row", F.explode(known.blocks()).alias("b"))
    blocks = blocks.select("row", F.col("b.class").alias("class"), F.array_intersect(strings(known.order), F.col("b.known")).alias("known"))
    probes = blocks.select("*", F.posexplode(F.slice("known", F.lit(1), F.size("known") - least[F.col("class")] + 1)).alias("j", "token"))
    fits = probes.join(index, ["class", "token"]).where("need <= size(known) and need <= 1 + least(size - i - 1, size(known) - j - 1)")
    met = fits.withColumn("common", F.size(F.array_intersect("known", "wanted"))).where("common >= need")
    found = met.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.col("common") / F.col("size")).alias("held"))
    all_labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("held", F.lit(0.0)))
    return narrow.join(found, "row", "left").select(*narrow.columns[1:], all_labels.alias("labels"), score.alias("score"))


def plain_words(text: str) -> list[str]:
    """words_of() for a template."""
    return [w for w in re.split(BETWEEN, text.replace(KELVIN, KAPPA).lower()) if w]


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(common.table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})


def oracle(templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, share: float = CONTAINMENT) -> str:
    """SQL that holds every block of every document against every template."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    said = ", ".join(f"({listed(p.split())}, '{label}')" for p, label in phrases.items())
    told = [(label, plain_words(t)) for label, t in templates]
    wanted = ", ".join(f"({listed(sorted(set(w)))}, '{label}', {1 << (len(w) - 1).bit_length()}, {math.ceil(round(share * len(set(w)), 9))})" for label, w in told)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
phrases(words, label) AS (VALUES {said}), templates(words, label, class, need) AS (VALUES {wanted}),
hits AS (SELECT r, label, i FROM d, unnest(range(0, len(w))) AS u(i), phrases WHERE w[i + 1 : i + len(words)] = words),
base AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY r),
blocks AS (SELECT r, class, list_distinct(w[k * class + 1 : k * class + 2 * class]) AS known FROM d, (SELECT DISTINCT class FROM templates), unnest(range(0, greatest(1, ceil(len(w) / class)::BIGINT - 1))) AS u(k)),
met AS (SELECT r, label, len(list_intersect(known, words)) AS n, len(words) AS size FROM blocks JOIN templates USING (class) WHERE len(list_intersect(known, words)) >= need),
held AS (SELECT r, max(n / size) AS share FROM met GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM hits UNION ALL SELECT r, label FROM met) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN held USING (r) LEFT JOIN every USING (r)
"""
