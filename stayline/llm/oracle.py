"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_LEDGER = r"""
words AS (
  SELECT rowid_ AS r, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT rowid_, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts)
),
windows AS (
  SELECT r, i, word, lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)
),
repeated AS (
  SELECT r, i FROM windows WHERE third IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, word, second, third) > 1
),
covered AS (
  SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS place FROM repeated) GROUP BY r
),
word_counts AS (
  SELECT r, count(*) AS n, sum(length(word))::BIGINT AS chars FROM words GROUP BY r
),
line_counts AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT rowid_ AS r, unnest(string_split(t, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
),
ledger AS (
  SELECT rowid_, coalesce(w.n, 0) AS n_words, coalesce(w.chars, 0) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM texts LEFT JOIN word_counts w ON w.r = rowid_ LEFT JOIN line_counts l ON l.r = rowid_
    LEFT JOIN covered c ON c.r = rowid_
),
judged AS (
  SELECT *, n_words < 50 AS f0, 100 * n_repeat_words > 50 * n_words AS f1, 10 * n_symbols > n_words AS f2,
    2 * n_dup_lines > n_lines AS f3, word_chars < 3 * n_words OR word_chars > 12 * n_words AS f4
  FROM ledger
)
"""

OP7 = rf"""
WITH texts AS (SELECT row_number() OVER () AS rowid_, doc_id, coalesce(text, '') AS t FROM documents),
{_LEDGER}
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
  f0::INT + 2 * f1::INT + 4 * f2::INT + 8 * f3::INT + 16 * f4::INT AS failed_rules,
  f0 OR f1 AS base_failed, NOT (f0 OR f1 OR f2 OR f3 OR f4) AS kept
FROM judged JOIN texts USING (rowid_)
"""


OP4 = r"""
WITH sizes AS (
  SELECT source, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS bytes FROM documents GROUP BY source
),
weights AS (SELECT *, pow(bytes::DOUBLE, 0.7) AS weight FROM sizes),
totals AS (SELECT sum(weight::DECIMAL(38, 12))::DOUBLE AS weight, sum(bytes) AS bytes FROM weights),
rates AS (
  SELECT source, round(w.weight / t.weight * t.bytes / w.bytes, 9) AS rate FROM weights w, totals t
),
parts AS (SELECT source, greatest(ceil(rate / 500), 1)::INTEGER AS n, rate / greatest(ceil(rate / 500), 1) AS rate FROM rates),
steps AS (
  SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM (
    SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM parts, range(0, 1000) AS r(k) WHERE k <= rate + 12 * sqrt(rate) + 40)
),
named AS (
  SELECT *, row_number() OVER () AS r, coalesce(doc_id::VARCHAR, text, 'null') AS who FROM documents
),
drawn AS (
  SELECT r, d.source, j, ('0x' || md5(CASE WHEN n = 1 THEN 'mix-1:' || who ELSE 'mix-1:part:' || j || ':' || who END)[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM named d JOIN parts p ON p.source IS NOT DISTINCT FROM d.source, LATERAL (SELECT unnest(range(1, n + 1)) AS j)
),
copies AS (
  SELECT r, count(*) AS n FROM drawn d JOIN steps s ON s.source IS NOT DISTINCT FROM d.source AND s.c <= d.u GROUP BY r
)
SELECT doc_id, text, lang, source, n_chars, k::INTEGER AS copy, md5('mix-1:' || k::INTEGER || ':' || who) AS mix_key
FROM named JOIN copies USING (r), LATERAL (SELECT unnest(range(0, copies.n)) AS k)
"""


OP12 = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units
  FROM documents
),
numbers AS (
  SELECT doc_id, t, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM drawn
),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
),
cut AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix
  FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""


OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
),
found AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM found GROUP BY lang, source, term),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
shares AS (
  SELECT lang, source, term, n,
    (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)))::BIGINT AS p
  FROM cells
),
lang_shares AS (
  SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)))::BIGINT AS q
  FROM kept
),
pair_sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
rows_of AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM rows_of
) WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mix_sources": OP4,
        "op7_quality_ledger": OP7,
        "op12_fill_in_middle": OP12,
        "op13_source_divergence": OP13,
    }
