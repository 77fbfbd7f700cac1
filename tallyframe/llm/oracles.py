"""SQL of the training-data queries that SQL can express, for small tables."""

from __future__ import annotations

from tallyframe.llm import hard_negatives, license_scan, quality, url_filter

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i : i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS u(i)),
hit AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + k AS pos FROM hit, unnest(range(0, 35)) AS x(k)),
word AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM word ANTI JOIN gone USING (r, pos) GROUP BY r)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS shingles FROM d),
e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS sh FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS all_n, count(*) AS common_n FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (SELECT a, b FROM p WHERE 100 * common_n >= 75 * all_n UNION ALL SELECT b, a FROM p WHERE 100 * common_n >= 75 * all_n),
reach(node, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT node, l.b FROM reach JOIN l ON other = l.a)
SELECT s.doc_id, len(shingles) AS n_shingles, min(other) AS component_id, s.doc_id = min(other) AS kept FROM s JOIN reach ON node = s.doc_id GROUP BY s.doc_id, shingles
"""


def part(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"


def divergence(rows: str) -> str:
    """Jensen-Shannon distance by r of rows (r, k, x, y), x and y being counts."""
    return f"""(SELECT r, CASE WHEN max(sx) > 0 AND max(sy) > 0 THEN sqrt(greatest(0, sum({part("p", "q")} + {part("q", "p")}) / 2)) ELSE 0 END AS dist
  FROM (SELECT r, x / nullif(sx, 0) AS p, y / nullif(sy, 0) AS q, sx, sy FROM (SELECT r, x::DOUBLE AS x, y::DOUBLE AS y, (sum(x) OVER (PARTITION BY r))::DOUBLE AS sx, (sum(y) OVER (PARTITION BY r))::DOUBLE AS sy FROM {rows})) GROUP BY r)"""


COUNTED = ", ".join(f"length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g'))" for p in [*quality.CLASSES.values(), "[^a-z]+"])
N = len(quality.CLASSES) + 3
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lg, lang IS NULL AS ln, coalesce(text, '') AS t, {WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
c AS (SELECT r, lg, ln, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) AS n_chars, [{COUNTED}, length(t) - length(array_to_string(w, ''))] AS counted FROM d),
classes AS (SELECT r, lg, ln, n_words, n_chars, list_append(counted, n_chars - list_sum(counted)) AS cc FROM c),
win AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS h FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
twice AS (SELECT r, h FROM win GROUP BY r, h HAVING count(*) > 1),
rep AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + k AS pos FROM win SEMI JOIN twice USING (r, h), unnest(range(0, 5)) AS x(k)) GROUP BY r),
ref AS (SELECT lg, ln, k, sum(cc[k]) AS y FROM classes, unnest(range(1, {N + 1})) AS u(k) GROUP BY ALL),
cd AS {divergence("(SELECT r, u.k, cc[u.k] AS x, y FROM classes, unnest(range(1, " + str(N + 1) + ")) AS u(k) JOIN ref ON ref.lg = classes.lg AND ref.ln = classes.ln AND ref.k = u.k)")},
tok AS (SELECT r, lg, ln, unnest(regexp_split_to_array(lower(t), '[^\p{{L}}]+')) AS tok FROM d),
top AS (SELECT * FROM (SELECT lg, ln, tok, count(*) AS n, row_number() OVER (PARTITION BY lg, ln ORDER BY count(*) DESC, tok) AS k FROM tok WHERE tok <> '' GROUP BY lg, ln, tok) WHERE k <= {quality.COMMON}),
seen AS (SELECT r, k, count(*) AS x FROM tok JOIN top USING (lg, ln, tok) GROUP BY r, k),
total AS (SELECT lg, ln, sum(n_words) AS n FROM classes GROUP BY lg, ln), known AS (SELECT lg, ln, sum(n) AS n FROM top GROUP BY lg, ln), mine AS (SELECT r, sum(x) AS n FROM seen GROUP BY r),
wd AS {divergence("(SELECT classes.r, top.k, coalesce(x, 0) AS x, top.n AS y FROM classes JOIN top ON top.lg = classes.lg AND top.ln = classes.ln LEFT JOIN seen ON seen.r = classes.r AND seen.k = top.k UNION ALL SELECT classes.r, 0, greatest(0, n_words - coalesce(mine.n, 0)), greatest(0, total.n - coalesce(known.n, 0)) FROM classes JOIN total USING (lg, ln) LEFT JOIN known USING (lg, ln) LEFT JOIN mine ON mine.r = classes.r)")},
f AS (SELECT d.doc_id, c.n_words, word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, n_chars, cd.dist AS cdist, wd.dist AS wdist
  FROM d JOIN c USING (r) LEFT JOIN rep USING (r) JOIN cd USING (r) JOIN wd USING (r)),
g AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_chars >= {quality.MIN_CHARS} AND cdist > {quality.MAX_CLASS} OR n_words >= {quality.MIN_WORDS} AND wdist > {quality.MAX_WORDS}) AS kept,
  round(cdist, 6)::DOUBLE AS class_distance, round(wdist, 6)::DOUBLE AS word_distance FROM g
"""

ORACLES = {"op6_quality_rules": QUALITY, "op7_substring_dedup": SUBSTRING, "op9_near_dedup": NEAR, "op10_url_filter": url_filter.ORACLE_SQL, "op12_hard_negatives": hard_negatives.ORACLE_SQL, "op13_license_scan": license_scan.oracle()}
