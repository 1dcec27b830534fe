"""DuckDB SQL for the queries that SQL can express."""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"

_PART = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
_DISTANCE = f"sqrt(greatest(0, sum({_PART.format('p', 'q')} + {_PART.format('q', 'p')}) / 2))"

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, text IS NOT NULL AS known, coalesce(text, '') AS t FROM documents),
x AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, regexp_extract_all(lower(t), '\p{{L}}+') AS plain, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
y AS (SELECT rid, doc_id, lang, known, w, plain, length(t) AS n, len(w) AS n_words, len(plain) AS n_plain, coalesce(list_sum(list_transform(w, lambda a: length(a))), 0) AS word_chars, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS c0, length(regexp_replace(t, '[^0-9]', '', 'g')) AS c1, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS c2, length(regexp_replace(t, '[^!?]', '', 'g')) AS c3, length(regexp_replace(t, '[^.,;:''"()-]', '', 'g')) AS c4 FROM x),
z AS (SELECT *, n - word_chars AS c5, word_chars - c0 - c1 - c2 - c3 - c4 AS c6 FROM y),
g AS (SELECT rid, i AS pos, array_to_string(w[i + 1 : i + 8], ' ') AS g FROM z, unnest(range(n_words - 7)) u(i)),
again AS (SELECT rid, pos FROM g JOIN (SELECT rid, g FROM g GROUP BY ALL HAVING count(*) > 1) USING (rid, g)),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(pos, pos + 8)) AS p FROM again) GROUP BY rid),
cells AS (SELECT rid, lang, known, n, n_words, c5, u.c AS class, u.k AS k FROM z, unnest([{{'c': 0, 'k': c0}}, {{'c': 1, 'k': c1}}, {{'c': 2, 'k': c2}}, {{'c': 3, 'k': c3}}, {{'c': 4, 'k': c4}}, {{'c': 5, 'k': c5}}, {{'c': 6, 'k': c6}}]) q(u)),
steps AS (SELECT lang, class, 10000 * k // n AS step FROM cells WHERE known AND c5 >= 19),
tally AS (SELECT lang, class, step, count(*) AS k FROM (SELECT * FROM steps UNION ALL SELECT NULL, class, step FROM steps) GROUP BY ALL),
cum AS (SELECT lang, class, step, sum(k) OVER (PARTITION BY lang, class ORDER BY step) AS below, sum(k) OVER (PARTITION BY lang, class) AS docs FROM tally),
med AS (SELECT lang, class, (min(step) + 0.5) / 10000.0 AS m FROM cum WHERE 2 * below >= docs AND docs >= 20 GROUP BY ALL),
ref AS (SELECT lang, class, m / sum(m) OVER (PARTITION BY lang) AS q FROM med),
cd AS (SELECT rid, {_DISTANCE} AS cd FROM (SELECT rid, k / n AS p, coalesce(r.q, a.q) AS q FROM cells c LEFT JOIN ref r ON r.lang = c.lang AND r.class = c.class JOIN ref a ON a.lang IS NULL AND a.class = c.class WHERE n_words >= 40) GROUP BY rid),
words AS (SELECT lang, a, count(*) AS k FROM (SELECT lang, unnest(plain) AS a FROM z WHERE known AND lang IN (SELECT lang FROM ref)) GROUP BY ALL),
total AS (SELECT lang, sum(k) AS total FROM words GROUP BY lang),
top AS (SELECT lang, a, k / total AS q FROM words JOIN total USING (lang) WHERE length(a) <= 32 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY k DESC, a) <= 24),
own AS (SELECT rid, lang, n_plain, unnest(plain) AS a FROM z WHERE n_words >= 40 AND lang IN (SELECT lang FROM total)),
found AS (SELECT rid, a, count(*) AS k FROM own JOIN top USING (lang, a) GROUP BY ALL),
shares AS (SELECT z.rid, coalesce(f.k, 0) / z.n_plain AS p, t.q FROM z JOIN top t USING (lang) LEFT JOIN found f ON f.rid = z.rid AND f.a = t.a WHERE n_words >= 40 AND n_plain > 0),
rest AS (SELECT rid, 1 - sum(p) AS p, greatest(0, 1 - sum(q)) AS q FROM shares GROUP BY rid),
wd AS (SELECT rid, {_DISTANCE} AS wd FROM (SELECT * FROM shares UNION ALL SELECT * FROM rest) GROUP BY rid),
v AS (SELECT z.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * n_words AS base_failed, cd, wd FROM z LEFT JOIN rep USING (rid) LEFT JOIN cd USING (rid) LEFT JOIN wd USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(c2 AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND coalesce(cd, 0) <= 0.25 AND coalesce(cd + wd <= 0.2 + 3.0 / sqrt(n_words), true) AS kept FROM v""",
    "op6_benchmark_decontamination": f"""
WITH b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark WHERE text IS NOT NULL),
k AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i + 1 : i + 10], ' ') AS g FROM b, unnest(range(greatest(len(w) - 9, 1))) u(i) WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce({_ALNUM}, []) AS w FROM documents),
g AS (SELECT doc_id, i AS pos, size, array_to_string(w[i + 1 : i + size], ' ') AS g FROM d, (SELECT DISTINCT size FROM k) z, unnest(range(len(w) - size + 1)) u(i)),
h AS (SELECT doc_id, pos, size, item_id FROM g JOIN k USING (size, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)""",
    "op8_minhash_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_SPACED}, []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS g FROM w, unnest(range(greatest(len(w) - 3, 1))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, least(min(b), a) AS c FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, doc_id) AS component_id, coalesce(m.c, doc_id) = doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op11_filter_interaction_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN least < doc_id THEN 'E' ELSE '' END AS fails
  FROM w JOIN m USING (t) LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
r AS (SELECT f.*, filter_order, coalesce(list_min(list_transform(list_filter(range(1, 6), lambda i: contains(fails, filter_order[i])), lambda i: i)), 6) AS first FROM f, o),
s AS (SELECT r.*, step, filter_order[step] AS letter FROM r, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, filter_order, step, letter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed, count(*) FILTER (first < step AND contains(fails, letter)) AS redundant,
  count(*) FILTER (fails = letter) AS unique_fails, count(*) FILTER (first = step AND good = 1) AS good_lost, count(*) FILTER (first = step AND toxic = 1) AS toxic_lost FROM s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM g""",
    "op13_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce({_SPACED}, []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS g FROM w, unnest(range(greatest(len(w) - 3, 1))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, least(min(b), a) AS c FROM r GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op9_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, j AS base, substr(h, 2 * j + 1, 1098) AS c FROM d, unnest(range(0, strlen(h) // 2, 500)) u(j)),
w AS (SELECT doc_id, base + i AS i, substr(c, 2 * i + 1, 100) AS s FROM c, unnest(range(least(strlen(c) // 2 - 49, 500))) u(i)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS fresh FROM (SELECT DISTINCT doc_id, i FROM w JOIN m USING (s) WHERE least < doc_id)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) GROUP BY doc_id, k),
p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM r),
k AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept, max(b) AS last FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
}
