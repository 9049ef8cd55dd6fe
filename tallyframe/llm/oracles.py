"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# The verdict of operator 3 in SQL: the rules of the operator's docstring, written out.
ORACLES["op3_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, doc_id, text,
         [x for x in regexp_split_to_array(text, '[ \t\n\x0B\f\r]+') if x <> ''] AS words,
         [x for x in string_split(text, chr(10)) if regexp_matches(x, '[^ \t\n\x0B\f\r]')] AS lines FROM d),
win AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM w, unnest(range(1, len(words) - 3)) AS t(i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM win),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, unnest(range(0, 5)) AS t(o) WHERE k > 1 GROUP BY r),
judged AS (
  SELECT r, len(regexp_replace(l, '[ \t\n\x0B\f\r]+', '', 'g')) AS visible,
         NOT regexp_matches(l, '\p{L}')
         OR (runs >= 3 AND runs * 4 >= n)
         OR (n >= 12 AND NOT regexp_matches(l, '[.!?,;:…。]'))
         OR low IN ('home', 'menu', 'search', 'next', 'previous', 'login', 'log in', 'sign in', 'sign up', 'register',
                    'contact', 'contact us', 'about', 'about us', 'back to top', 'read more', 'share', 'site map')
         OR (seps >= 2 AND seps * 4 >= n)
         OR (n <= 40 AND regexp_matches(low, 'all rights reserved|cookie policy|we use cookies|accept cookies|privacy policy|terms of use|terms of service|enable javascript|requires javascript|subscribe to our newsletter|lorem ipsum|click here to'))
         AS bad
  FROM (SELECT r, l, lower(trim(l, ' ')) AS low,
               len(regexp_split_to_array(lower(trim(l, ' ')), '[ \t\n\x0B\f\r]+')) AS n,
               len(regexp_extract_all(l, '!{2,}|\?{2,}|#{2,}|\*{2,}|\${2,}|%{2,}|&{2,}')) AS runs,
               len(regexp_extract_all(regexp_replace(l, '[ \t\n\x0B\f\r]', '  ', 'g') || ' ',
                                      '[ ][|»›>•·][ ]')) AS seps
        FROM w, unnest(lines) AS t(l))),
lost AS (SELECT r, coalesce(sum(CASE WHEN bad THEN visible END), 0) AS lost FROM judged GROUP BY r),
base AS (
  SELECT w.r, doc_id, len(words)::BIGINT AS n_words,
         len(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= 50 * word_chars AS kept
FROM base
"""

_SETS = r"""
words AS (
  SELECT {id} AS id, [x for x in regexp_split_to_array({lower}, '[ \t\n\x0B\f\r]+') if x <> ''] AS w FROM {table}),
grams AS (
  SELECT DISTINCT id, array_to_string(w[i:i + {width} - 1], ' ') AS g
  FROM words, unnest(range(1, greatest(len(w) - {width} + 1, 1) + 1)) AS t(i) WHERE len(w) > 0)"""

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def components_sql(table: str, width: int, percent: int) -> str:
    """CTEs ending in ``comp`` (id, n, component) over ``table`` (doc_id, text)."""
    return _SETS.format(id="doc_id", lower=_ASCII_LOWER, table=table, width=width) + f""",
sizes AS (SELECT id, count(*) AS n FROM grams GROUP BY id),
rare AS (
  SELECT id, g, row_number() OVER (PARTITION BY id ORDER BY df, g) AS p
  FROM (SELECT id, g, count(*) OVER (PARTITION BY g) AS df FROM grams)),
prefix AS (SELECT rare.id, g FROM rare JOIN sizes USING (id) WHERE p <= n - ceil({percent} * n / 100.0 - 1e-6) + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.g = b.g AND a.id < b.id),
overlap AS (SELECT a, b, count(*) AS c FROM pairs JOIN grams x ON x.id = a JOIN grams y ON y.id = b AND y.g = x.g
            GROUP BY a, b),
linked AS (SELECT a, b FROM overlap JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b
           WHERE 100 * c >= {percent} * (x.n + y.n - c)),
edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reach AS (SELECT DISTINCT id, id AS other FROM words UNION SELECT reach.id, b FROM reach JOIN edges ON other = a),
comp AS (SELECT reach.id, coalesce(max(n), 0)::BIGINT AS n, min(other) AS component
         FROM reach LEFT JOIN sizes ON sizes.id = reach.id GROUP BY reach.id)"""


ORACLES["op4_jaccard_join"] = ("WITH RECURSIVE " + components_sql("documents", 4, 85) + """
SELECT id AS doc_id, n AS n_shingles, component AS component_id FROM comp""")


def contained_sql(docs: str, percent: int = 80, width: int = 5) -> str:
    """CTEs ending in ``contained`` (doc_id, item_id, n_item_shingles, n_common, containment)."""
    text = "lower(coalesce(text, ''))"
    d = _SETS.format(id="doc_id", lower=text, table=docs, width=width)
    i = _SETS.format(id="item_id", lower=text, table="benchmark", width=width)
    for name in ("words", "grams"):
        d = d.replace(name, f"d_{name}")
        i = i.replace(name, f"i_{name}")
    return f"""{d}, {i},
d_all AS (
  SELECT id, g FROM d_grams
  UNION
  SELECT id, array_to_string(w[i:i + k - 1], ' ')
  FROM d_words, (SELECT DISTINCT len(w) AS k FROM i_words WHERE len(w) BETWEEN 1 AND {width - 1}) s,
       unnest(range(1, len(w) - k + 2)) AS t(i)),
i_size AS (SELECT id, count(*) AS m FROM i_grams GROUP BY id),
contained AS (
  SELECT d.id AS doc_id, i.id AS item_id, max(m)::BIGINT AS n_item_shingles, count(*)::BIGINT AS n_common,
         count(*) / max(m)::DOUBLE AS containment
  FROM i_grams i JOIN d_all d ON d.g = i.g JOIN i_size s ON s.id = i.id
  GROUP BY d.id, i.id HAVING 100 * count(*) >= {percent} * max(m))"""


ORACLES["op8_decontaminate"] = "WITH " + contained_sql("documents") + "\nSELECT * FROM contained"


_CLEAN_WORDS = r"[x for x in regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+') if x <> '']"

# CRC-32 bit by bit, as DuckDB has no function for it.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda c: list_transform(range(0, 8), lambda j: CAST((ascii(c) >> CAST(j AS INT)) & 1 AS BIGINT))))),
  lambda c, b: CASE WHEN xor(c & 1, b) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""

ORACLES["op11_periodic_runs"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CLEAN_WORDS} AS o, {_CRC} AS h FROM documents),
cut AS (SELECT r, doc_id, o, len(o) AS n, h % 10 = 0 AND len(o) > 0 AS planted, (h // 10) AS g FROM d),
place AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM cut),
texts AS (SELECT r, doc_id, n, CASE WHEN planted THEN
            [o[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1] for i in range(0, n)] ELSE o END AS w FROM place),
words AS (SELECT r, n, i, w[i + 1] AS x FROM texts, unnest(range(0, n)) AS t(i)),
equal AS (SELECT a.r, a.i, b.i - a.i AS q FROM words a JOIN words b
          ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM equal),
stretches AS (SELECT r, min(i) AS start, count(*) + q AS length, q FROM islands GROUP BY r, q, island
              HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length),
gone AS (SELECT DISTINCT r, i FROM runs, unnest(range(start + period, start + length)) AS t(i)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r),
per AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
               min(struct_pack(l := -length, s := start, p := period)) AS best FROM runs GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, (-best.l)::BIGINT AS length,
       best.p::BIGINT AS period, (1000 * -best.l // best.p)::BIGINT AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM texts LEFT JOIN per USING (r) LEFT JOIN kept USING (r)
"""

ORACLES["op12_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (
  SELECT *, regexp_extract_all(text, '[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+') AS units,
         [CAST('0x' || x[8 * k + 1:8 * k + 8] AS BIGINT) for k in range(0, 4)] AS h FROM d),
cuts AS (
  SELECT *, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a,
         greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50
              THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
parts AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
         array_to_string(units[b + 1:len(units)], '') AS s FROM cuts)
SELECT doc_id, len(units)::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

ORACLES["op13_substring_dedup"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CLEAN_WORDS} AS w FROM documents),
windows AS (SELECT r, i, array_to_string(w[i + 1:i + 35], ' ') AS g FROM d, unnest(range(0, len(w) - 34)) AS t(i)),
often AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + o AS i FROM windows JOIN often USING (g), unnest(range(0, 35)) AS t(o)),
words AS (SELECT r, i, w[i + 1] AS x FROM d, unnest(range(0, len(w))) AS t(i)),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
