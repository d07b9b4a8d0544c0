"""SQL twins, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from plumbline.llm import quality_rules, vector_codes

WORD = r"[^\x20\x09-\x0D]+"


def _broken(t: quality_rules.Threshold) -> str:
    bounds = [f"{t.measure} {sign} {bound} * {t.per}" for sign, bound in (("<", t.least), (">", t.most)) if bound is not None]
    return f"({t.per} > 0 AND ({' OR '.join(bounds)}))"


def quality() -> str:
    """``op12_quality_rules``."""
    blank = quality_rules.BLANKS.encode("unicode_escape").decode()
    stop = ", ".join(f"'{w}'" for words in quality_rules.STOP_WORDS.values() for w in words.split())
    base = [t for t in quality_rules.THRESHOLDS if t.base]
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rn, doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
places AS (SELECT rn, unnest(range(1, len(w) - 3)) AS i, w FROM w),
wins AS (SELECT rn, i, array_to_string(w[i:i + 4], ' ') AS k FROM places),
twice AS (SELECT rn, k FROM wins GROUP BY rn, k HAVING count(*) > 1),
covered AS (SELECT rn, count(DISTINCT i + j) AS n FROM wins JOIN twice USING (rn, k), range(5) AS r(j) GROUP BY rn),
m AS (SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
             len(t) - len(regexp_replace(t, '[{quality_rules.SYMBOLS}]', '', 'g')) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '^[{blank}]*[-*•‣◦·][{blank}]'))) AS n_bullet_lines,
             len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[{blank}]*$'))) AS n_ellipsis_lines,
             len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
             len(list_filter(regexp_extract_all(lower(t), '\p{{L}}+'), lambda x: x IN ({stop}))) AS n_stop_words,
             len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter_words,
             coalesce(c.n, 0) AS n_repeat_words, 100 * coalesce(c.n, 0) AS n_repeat_words_100
      FROM w LEFT JOIN covered AS c USING (rn))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {' OR '.join(map(_broken, base))} AS base_failed, NOT ({' OR '.join(map(_broken, quality_rules.THRESHOLDS))}) AS kept
FROM m"""


def codes(parts: int = vector_codes.PARTS, entries: int = vector_codes.ENTRIES, rounds: int = vector_codes.ROUNDS) -> str:
    """``op13_vector_codes``: whole rounds written out one after the other."""
    def nearest(t: int) -> str:
        # Inner products of whole numbers are exact in double precision.
        return f"""
a{t} AS MATERIALIZED (
    SELECT x.rn, x.p, min({{'d': x.q - 2 * list_inner_product(x.f, b.f) + b.q, 'k': b.k}}) AS m
    FROM part AS x JOIN f{t} AS b ON x.p = b.p GROUP BY x.rn, x.p)"""

    def entries_of(t: int) -> str:
        return f"""
f{t} AS MATERIALIZED (SELECT p, k, c, CAST(c AS DOUBLE[]) AS f, list_inner_product(CAST(c AS DOUBLE[]), CAST(c AS DOUBLE[])) AS q FROM b{t})"""

    def averaged(t: int) -> str:
        return f"""
s{t} AS (SELECT p, k, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
         FROM (SELECT a.p, a.m.k AS k, unnest(part.v) AS x, generate_subscripts(part.v, 1) AS j
               FROM a{t - 1} AS a JOIN part ON a.rn = part.rn AND a.p = part.p) GROUP BY p, k, j),
b{t} AS MATERIALIZED (
    SELECT b.p, b.k, coalesce(n.c, b.c) AS c FROM b{t - 1} AS b
    LEFT JOIN (SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{t} GROUP BY p, k) AS n
           ON n.p = b.p AND n.k = b.k)"""

    steps = [f"""
b0 AS MATERIALIZED (SELECT p, rn AS k, v AS c FROM part WHERE rn < {entries})"""]
    for t in range(rounds + 1):
        steps += ([averaged(t)] if t else []) + [entries_of(t), nearest(t)]
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rn, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (
    SELECT rn, p, v[p * w + 1:(p + 1) * w] AS v, CAST(v[p * w + 1:(p + 1) * w] AS DOUBLE[]) AS f,
           list_inner_product(CAST(v[p * w + 1:(p + 1) * w] AS DOUBLE[]), CAST(v[p * w + 1:(p + 1) * w] AS DOUBLE[])) AS q
    FROM (SELECT *, len(v) // {parts} AS w FROM kept), range({parts}) AS r(p)),{','.join(steps)},
coded AS (SELECT rn, string_agg(format('{{:02x}}', m.k), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error
          FROM a{rounds} GROUP BY rn),
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rn), books"""
