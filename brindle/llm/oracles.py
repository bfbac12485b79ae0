"""DuckDB SQL of the operators that SQL can express, in forms for small tables: all pairs of alike documents, all variants of lines."""

from __future__ import annotations

from . import decontaminate, jaccard, linededup, mixing, rules

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"


def mix(weights=(1, 2, 3), cap: int = 3) -> str:
    """Sources filled in the order of cap to weight; each document's place in its source by the digest of its id."""

    def inverse(knots) -> str:
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        total, before, parts = sum(areas), 0.0, []
        for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
            slope = (w1 - w0) / (t1 - t0)
            a = f"(u * {total}::DOUBLE - {before}::DOUBLE)"
            parts.append((before + area, f"{t0}::DOUBLE + 2 * {a} / ({w0}::DOUBLE + sqrt(greatest({w0 * w0}::DOUBLE + {2 * slope}::DOUBLE * {a}, 0.0::DOUBLE)))"))
            before += area
        out = parts[-1][1]
        for end, t in reversed(parts[:-1]):
            out = f"CASE WHEN u * {total}::DOUBLE < {end}::DOUBLE THEN {t} ELSE {out} END"
        return out

    places = " ".join(f"WHEN {k} THEN {inverse(knots)}" for k, knots in enumerate(mixing.SCHEDULES))
    weight = " ".join(f"WHEN {k} THEN {float(w)}" for k, w in enumerate(weights))
    words = lambda p: f"greatest(0, least(size, goal - ({p} * source_size + start)))"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_SPACED})) AS size, md5(coalesce(CAST(doc_id AS STRING), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM s),
w AS (SELECT *, CAST(CASE (rank - 1) % {len(weights)} {weight} END AS DOUBLE) AS w, source_size * {float(cap)}::DOUBLE AS most FROM r),
l AS (SELECT *, most / w AS ratio FROM w),
f AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM l WINDOW b AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, rank, least(most, w * (SELECT arg_min(level, (ratio, rank)) FROM f WHERE level <= ratio)) AS target FROM f),
p AS (SELECT d.*, t.source_size, t.target, t.rank, CAST(round(t.target) AS BIGINT) AS goal, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, CAST({' + '.join(words(p) for p in range(cap))} AS BIGINT) AS taken, CASE WHEN {words(0)} > 0 THEN CAST(start AS DOUBLE) / goal END AS u FROM p)
SELECT doc_id, size, source_size, target, taken, CASE WHEN u IS NOT NULL THEN CASE (rank - 1) % {len(mixing.SCHEDULES)} {places} END END AS first_position FROM x"""


def line_dedup(least: int = linededup.LEAST) -> str:
    return rf"""
WITH u AS (SELECT doc_id, generate_subscripts(lines, 1) - 1 AS line, regexp_extract_all(unnest(lines), '[^ \t\r\x0B\f]+') AS w FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS lines FROM documents WHERE text IS NOT NULL)),
units AS (SELECT doc_id, line, w, array_to_string(w, ' ') AS x, doc_id::HUGEINT * 10000000000 + line AS place FROM u WHERE len(w) > 0),
firsts AS (SELECT x, min(place) AS place, any_value(w) AS w FROM units GROUP BY x),
v AS (SELECT x, place, i, hash(CASE WHEN i = 0 THEN x ELSE array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') END) AS key FROM (SELECT *, unnest(range(0, len(w) + 1)) AS i FROM firsts WHERE len(w) >= {least})),
b AS (SELECT *, min(place) OVER (PARTITION BY key, i) AS same, min(place) FILTER (WHERE i = 0) OVER (PARTITION BY key) AS whole, min(place) FILTER (WHERE i > 0) OVER (PARTITION BY key) AS part FROM v),
near AS (SELECT DISTINCT x FROM b WHERE (i > 0 AND (same < place OR whole < place)) OR (i = 0 AND part < place)),
j AS (SELECT doc_id, line, units.place > firsts.place AS exact, units.place = firsts.place AND x IN (SELECT x FROM near) AS close FROM units JOIN firsts USING (x))
SELECT d.doc_id, count(j.line) AS n_units, count(*) FILTER (WHERE exact) AS n_exact, count(*) FILTER (WHERE close) AS n_near, coalesce(string_agg(CAST(line AS STRING), ',' ORDER BY line) FILTER (WHERE exact OR close), '') AS dropped FROM documents d LEFT JOIN j USING (doc_id) GROUP BY d.doc_id"""


def quality_rules(r: rules.LineRules = rules.LineRules()) -> str:
    marks = "('|', '»', '›', '>', '·', '•', '::')"
    boilerplate = rules._BOILERPLATE.pattern.replace("'", "''")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
c AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
l0 AS (SELECT doc_id, generate_subscripts(lines, 1) AS j, unnest(lines) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM d)),
l1 AS (SELECT doc_id, j, line, regexp_extract_all(line, {_SPACED}) AS w FROM l0),
l2 AS (SELECT *, len(w) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY j) > 1 AS dup, len([x FOR x IN w IF x IN {marks}]) AS m, len(regexp_extract_all(line, '!{{2,}}|\?{{3,}}')) AS loud, len(regexp_extract_all(line, '[#*$%&|<>]')) AS odd FROM l1 WHERE len(w) > 0),
l3 AS (SELECT *, dup OR (m >= 3 AND m >= {r.navigation} * n) OR (n <= {r.boilerplate_words} AND regexp_matches(line, '(?i){boilerplate}')) OR (loud >= 3 AND loud >= {r.shouting} * n) OR (odd >= 3 AND odd >= {r.symbols} * length(line)) AS goes FROM l2),
l AS (SELECT doc_id, count(*) FILTER (WHERE dup) AS n_dup_lines, coalesce(sum(n) FILTER (WHERE goes), 0) AS n_lost_words FROM l3 GROUP BY doc_id),
x AS (SELECT d.doc_id, len(d.w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < {r.least_words} OR n_repeat_words > {r.repeated} * n_words AS base_failed, NOT base_failed AND n_lost_words <= {r.lost} * n_words AS kept FROM x"""


def decontamination(window: int = decontaminate.WINDOW, share: int = 20) -> str:
    own = lambda table, key: f"SELECT {key}, regexp_extract_all({_LOWER.format('text')}, {_ALNUM}) AS w FROM {table}"
    return f"""
WITH d AS ({own('documents', 'doc_id')}), b AS (SELECT CAST(item_id AS STRING) AS item, w, least(len(w), {window}) AS k FROM ({own('benchmark', 'item_id')}) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, hash(w[i:i + k - 1]) AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
dw AS (SELECT doc_id, k, i, hash(w[i:i + k - 1]) AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
h AS (SELECT doc_id, item, i, k FROM dw JOIN bw USING (k, g)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM h)) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id),
t AS (SELECT item, unnest(list_distinct(w)) AS v, len(list_distinct(w)) AS c, len(w) + len(w) // 4 AS span FROM b WHERE len(list_distinct(w)) >= {decontaminate.LEAST_TERMS}),
pos AS (SELECT doc_id, p, w[p] AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
o AS (SELECT doc_id, item, p, v, c, span FROM pos JOIN t USING (v)),
o2 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item ORDER BY p RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING) AS many FROM o),
o3 AS (SELECT a.doc_id, a.item, a.p, any_value(a.c) AS c, count(DISTINCT z.v) AS got FROM o2 a JOIN o z ON a.doc_id = z.doc_id AND a.item = z.item AND z.p BETWEEN a.p AND a.p + a.span - 1 WHERE a.many >= {decontaminate.NEAR_SHARE} * a.c GROUP BY ALL),
near AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY encode(item)) AS items FROM (SELECT DISTINCT doc_id, item FROM o3 WHERE got >= {decontaminate.NEAR_SHARE} * c) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(d.w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(m.items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {share} * coalesce(n_hit, 0) >= coalesce(len(d.w), 0) AS contaminated, coalesce(n_near, 0) AS n_near, sha256(coalesce(near.items, '')) AS near_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN near USING (doc_id)"""


def jaccard_join(words: int = jaccard.WORDS, percent: int = 85) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_SPACED}) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, hash(w[i:i + least(len(w), {words}) - 1]) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM r WHERE r.node = d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id)"""


def sql() -> dict[str, str]:
    return {"op3_mix": mix(), "op5_line_dedup": line_dedup(), "op7_quality_rules": quality_rules(), "op8_decontaminate": decontamination(), "op10_jaccard_join": jaccard_join()}
