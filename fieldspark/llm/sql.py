"""DuckDB SQL for the queries that SQL can express."""

WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

_RULES = ("base", "symbols", "lines", "length", "capitals")
_FAIL = {
    "base": "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)",
    "symbols": "n_symbols > 0.1::DOUBLE * n_words",
    "lines": "n_dup_lines > 0.3::DOUBLE * n_lines",
    "length": "(word_chars < 2.0::DOUBLE * n_words OR word_chars > 15.0::DOUBLE * n_words)",
    "capitals": "n_capitals > 0.4::DOUBLE * word_chars",
}

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, {WORDS} AS w, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d),
g AS (SELECT rid, i, w[i:i + 7] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
f AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '\P{{Lu}}+', '', 'g'))::BIGINT AS n_capitals FROM w LEFT JOIN r USING (rid)),
h AS (SELECT source, count(*) AS n, {", ".join(f"sum(CASE WHEN {_FAIL[k]} THEN 1 ELSE 0 END) AS k_{k}" for k in _RULES)} FROM f GROUP BY 1),
m AS (SELECT {", ".join(f"sum(k_{k}) / sum(n) AS m_{k}" for k in _RULES)} FROM h),
v AS (SELECT {", ".join(f"m_{k}, (SELECT sum(n * power(k_{k} / n - m_{k}, 2)) / sum(n) FROM h) AS v_{k}" for k in _RULES)} FROM m),
s AS (SELECT {", ".join(f"m_{k}, least(1e6, greatest(1.0, CASE WHEN v_{k} > 0 THEN m_{k} * (1 - m_{k}) / v_{k} - 1 ELSE 1e6 END)) AS s_{k}" for k in _RULES)} FROM v),
x AS (SELECT source, greatest({", ".join(f"(k_{k} + m_{k} * s_{k}) / (n + s_{k})" for k in _RULES)}) > 0.5 AS host_rejected FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_FAIL["base"]} AS base_failed,
  NOT ({" OR ".join(f"({_FAIL[k]})" for k in _RULES)}) AND NOT host_rejected AS kept, host_rejected
FROM f JOIN x ON f.source IS NOT DISTINCT FROM x.source
"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT a AS id, a AS c FROM e UNION SELECT e.a, r.c FROM r JOIN e ON e.b = r.id AND r.c < e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, coalesce(least(min(r.c), d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN r ON r.id = d.doc_id GROUP BY d.doc_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
o AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most, sum(source_size) OVER ()::DOUBLE AS words FROM s),
b AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM o),
f AS (SELECT *, (words - filled) / rest > most / weight AS cap FROM b),
t AS (SELECT *, CASE WHEN cap THEN most ELSE (words - sum(CASE WHEN cap THEN most ELSE 0 END) OVER ()) / sum(CASE WHEN cap THEN 0 ELSE weight END) OVER () * weight END AS target FROM f),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
v AS (SELECT *, greatest(0.0, target - whole * source_size) AS remain FROM u),
y AS (SELECT source, size, sum(size::DOUBLE) AS words, sum(size::DOUBLE * size) AS squares FROM d GROUP BY 1, 2),
z AS (SELECT y.source, size, remain - coalesce(sum(y.words) OVER (PARTITION BY y.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(squares) OVER (PARTITION BY y.source) - coalesce(sum(squares) OVER (PARTITION BY y.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS squares FROM y JOIN v ON y.source IS NOT DISTINCT FROM v.source),
i AS (SELECT source, min(CASE WHEN size > 0 AND size * rest >= squares THEN size END) AS sure, arg_max(CASE WHEN squares > 0 THEN rest / squares ELSE 0 END, CASE WHEN NOT (size > 0 AND size * rest >= squares) THEN size END) AS per FROM z GROUP BY 1),
q AS (SELECT d.doc_id, d.source, size, source_size, target, whole, remain, size >= sure AS certain, (('0x' || substr(md5(concat(coalesce(d.doc_id::VARCHAR, 'null'), '|0')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS z,
  least(1 - 1e-9, greatest(1e-12, coalesce(per, 0) * size)) AS share FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source JOIN i ON d.source IS NOT DISTINCT FROM i.source),
k AS (SELECT *, CASE WHEN certain THEN 0 ELSE (z / (1 - z)) / (share / (1 - share)) END AS rank FROM q),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE < remain AS near FROM k),
l AS (SELECT source, max(CASE WHEN near THEN rank END) AS last FROM c GROUP BY 1)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN (whole + CASE WHEN rank <= coalesce(last, -1) THEN 1 ELSE 0 END) * size ELSE 0 END)::BIGINT AS taken, c.source AS source
FROM c JOIN l ON c.source IS NOT DISTINCT FROM l.source
"""

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o GROUP BY ALL),
k AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM o GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.lang_n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS total FROM x GROUP BY ALL),
p AS (SELECT x.lang, x.source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v) AS q
  FROM x JOIN t ON x.lang = t.lang AND x.source = t.source JOIN v ON x.lang = v.lang),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  UNION ALL SELECT g.lang, g.source, 'pair', h.source, 0 FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source WHERE g.lang NOT IN (SELECT lang FROM v)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM z WHERE part = 'pair' OR rank <= 10
"""

_RUNS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13 = rf"""
WITH b AS (SELECT item_id::VARCHAR AS item, w, least(len(w), 10) AS n FROM (SELECT item_id, {_RUNS} AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_RUNS} AS w FROM documents),
p AS (SELECT rid, w, i, n FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d), (SELECT DISTINCT n FROM g) WHERE i + n - 1 <= len(w)),
h AS (SELECT rid, i, q.n, item FROM (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM p) q JOIN g ON q.n = g.n AND q.gram = g.gram),
c AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM h) GROUP BY 1),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""
