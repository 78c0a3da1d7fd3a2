"""The same questions in DuckDB SQL, written independently of the operators."""

from __future__ import annotations

from tidemark.llm.licenses import NOTICES

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_DEDUP = f"""
WITH d AS (SELECT doc_id, {_LOW} AS low FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(low) AS text_sha256
FROM d WINDOW g AS (PARTITION BY low)
"""

_MIX = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS h,
         row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) AS n,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
      FROM d GROUP BY source),
total AS (SELECT sum(source_size)::DOUBLE AS t FROM s),
-- Rounds: sources above their cap are set to it, and what is left is shared by weight among the others.
rounds(n, source, done, target) AS (
  SELECT 0, source, false, NULL::DOUBLE FROM s
  UNION ALL
  SELECT n + 1, source, done OR share >= cap, CASE WHEN done THEN target WHEN share >= cap THEN cap ELSE share END
  FROM (SELECT r.n, r.source, r.done, r.target, 3.0::DOUBLE * s.source_size AS cap,
               ((SELECT t FROM total) - coalesce(sum(CASE WHEN r.done THEN r.target END) OVER (), 0))
               / sum(CASE WHEN r.done THEN 0 ELSE s.w END) OVER () * s.w AS share
        FROM rounds r JOIN s ON r.source IS NOT DISTINCT FROM s.source
        WHERE r.n < (SELECT count(*) + 1 FROM s))),
plan AS (SELECT s.source, s.source_size, r.target, floor(r.target / greatest(s.source_size, 1))::BIGINT AS epochs
         FROM s JOIN rounds r ON s.source IS NOT DISTINCT FROM r.source
         WHERE r.n = (SELECT max(n) FROM rounds)),
q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
keyed AS (
  SELECT d.doc_id, d.source, d.size, d.h, d.n,
         -ln((('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '') || ':' || h || ':' || n), 1, 13))::BIGINT + 0.5::DOUBLE)
             / 4503599627370496.0::DOUBLE)
         / CASE q.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS k
  FROM d LEFT JOIN q ON d.doc_id = q.doc_id),
run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, h, n
                                  ROWS UNBOUNDED PRECEDING) - size AS start FROM keyed)
SELECT doc_id, size, plan.source_size, plan.target,
       (size * (epochs + CASE WHEN start < target - epochs * plan.source_size
                               AND 2 * start + size <= 2 * (target - epochs * plan.source_size)
                              THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run JOIN plan ON run.source IS NOT DISTINCT FROM plan.source
"""

_WORDS = f"regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_LEAKS = f"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, w[k:k + 9] AS gram
      FROM i, LATERAL (SELECT unnest(generate_series(1, len(w) - 9)) AS k) WHERE len(w) >= 10
      UNION SELECT item_id, w FROM i WHERE len(w) BETWEEN 1 AND 9),
n AS (SELECT DISTINCT len(gram) AS n FROM g),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, k, n, w[k:k + n - 1] AS gram FROM d, n,
      LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS k) WHERE len(w) >= n),
h AS (SELECT p.doc_id, p.k, p.n, g.item_id FROM p JOIN g ON p.gram = g.gram),
hit AS (SELECT doc_id, count(DISTINCT k + o) AS n_hit FROM h, LATERAL (SELECT unnest(range(n)) AS o) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_NOTICES = ", ".join(f"({i}, '{label}', string_split('{text}', ' '))" for i, (label, text) in enumerate(NOTICES))

_LICENSES = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ph AS (SELECT * FROM (VALUES ('mit', ['mit', 'license']), ('apache', ['apache', 'license']),
                             ('gpl', ['general', 'public', 'license'])) AS t(label, phrase)),
base AS (SELECT doc_id, label, k - 1 AS place FROM d, ph,
         LATERAL (SELECT unnest(generate_series(1, len(w) - len(phrase) + 1)) AS k)
         WHERE len(w) >= len(phrase) AND w[k:k + len(phrase) - 1] = phrase),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM base GROUP BY doc_id),
notices AS (SELECT number, label, list_distinct(words) AS words FROM (VALUES {_NOTICES}) AS t(number, label, words)),
terms AS (SELECT number, label, len(words) AS n, unnest(words) AS word FROM notices),
spots AS (SELECT doc_id, k, w[k] AS word FROM d, LATERAL (SELECT unnest(generate_series(1, len(w))) AS k)),
held AS (SELECT doc_id, number, label, n, k, spots.word FROM spots JOIN terms ON terms.word = spots.word),
-- Every window of 64 words that starts at a word of the notice: others hold no more than the next of these.
found AS (SELECT DISTINCT a.doc_id, a.label, count(DISTINCT b.word) / a.n AS share
          FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.number = b.number AND b.k BETWEEN a.k AND a.k + 63
          GROUP BY a.doc_id, a.number, a.label, a.n, a.k HAVING count(DISTINCT b.word) >= ceil(0.9 * a.n - 1e-9)),
best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY doc_id),
bl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
       FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(bl.labels, '') AS base_labels, coalesce(al.labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id)
"""

_HOST = "lower(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'))"
_PATH = "regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's')"

# Labels travel along the edges until each url knows the smallest one it can reach.
_URLS = f"""
WITH RECURSIVE rules AS (
  SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                        ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS t(verdict, rhost, rpath)),
p AS (SELECT page_id, url, html, {_HOST} AS host, {_PATH} AS path FROM pages),
known AS (SELECT DISTINCT url, html FROM p WHERE url LIKE '%://%'),
links AS (SELECT DISTINCT url, trim(unnest([
            regexp_extract(html, '<link\\b[^>]*\\brel=["'']?canonical\\b[^>]*\\bhref=["'']([^"'']+)', 1, 'is'),
            regexp_extract(html, '<link\\b[^>]*\\bhref=["'']([^"'']+)["''][^>]*\\brel=["'']?canonical\\b', 1, 'is'),
            regexp_extract(html, '<meta\\b[^>]*\\bhttp-equiv=["'']?refresh\\b[^>]*\\bcontent=["''][^"'']*?url=([^"''>]+)', 1, 'is'),
            regexp_extract(html, '<meta\\b[^>]*\\bproperty=["'']?og:url\\b[^>]*\\bcontent=["'']([^"'']+)', 1, 'is')])) AS link
          FROM known),
found AS (SELECT DISTINCT url AS src, CASE
            WHEN link LIKE '%://%' THEN link
            WHEN link LIKE '//%' THEN regexp_extract(url, '^(.*?)://', 1, 's') || ':' || link
            WHEN link LIKE '/%' THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || link
            ELSE regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's')
                 || coalesce(nullif(regexp_replace({_PATH}, '[^/]*$', ''), ''), '/') || link END AS dst
          FROM links WHERE link <> ''),
urls AS (SELECT url FROM known UNION SELECT dst FROM found),
plain AS (SELECT url, regexp_replace({_HOST}, '^www\\.', '')
                      || regexp_replace({_PATH}, '(/index\\.html?|\\.html?|/)$', '')
                      || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_sort(q), '&') ELSE '' END AS form
          FROM (SELECT url, list_filter(string_split(regexp_extract(url, '^.*?://[^?#]*\\?([^#]*)', 1, 's'), '&'),
                            lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')) AS q
                FROM urls)),
-- Addresses and plain forms are nodes of two kinds: a form may quote an address.
pairs AS (SELECT 'u:' || url AS a, 'f:' || form AS b FROM plain UNION SELECT 'u:' || src, 'u:' || dst FROM found),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.seen = e.a),
comp AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
ranked AS (SELECT u.url, verdict, rhost || rpath AS rule,
                  row_number() OVER (PARTITION BY u.url ORDER BY length(rhost || rpath) DESC, verdict) AS n
           FROM (SELECT url, {_HOST} AS host, {_PATH} AS path FROM urls) u, rules
           WHERE (host = rhost OR suffix(host, '.' || rhost)) AND prefix(path, rpath)),
best AS (SELECT * FROM ranked WHERE n = 1),
spread AS (SELECT root, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
           FROM best JOIN comp ON comp.node = 'u:' || best.url GROUP BY root)
SELECT p.page_id, host, path, rule, coalesce(best.verdict, spread.verdict, 'allow') AS verdict
FROM p LEFT JOIN best ON p.url = best.url LEFT JOIN comp ON comp.node = 'u:' || p.url LEFT JOIN spread ON spread.root = comp.root
"""

_BACKOFF = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, k, w[k] AS w1, CASE WHEN k >= 2 THEN w[k - 1:k] END AS w2, CASE WHEN k >= 3 THEN w[k - 2:k] END AS w3
      FROM d, LATERAL (SELECT unnest(generate_series(1, len(w))) AS k)),
total AS (SELECT count(*)::DOUBLE AS n FROM p),
c1 AS (SELECT w1, count(*)::DOUBLE AS n FROM p GROUP BY 1),
c2 AS (SELECT w2, count(*)::DOUBLE AS n FROM p WHERE w2 IS NOT NULL GROUP BY 1),
c3 AS (SELECT w3, count(*)::DOUBLE AS n FROM p WHERE w3 IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
s AS (SELECT r, c3.n IS NOT NULL AS whole,
             CASE WHEN c3.n IS NOT NULL THEN ln(c3.n / h2.n)
                  ELSE CASE WHEN p.w3 IS NULL THEN 0.0::DOUBLE ELSE ln(0.4::DOUBLE) END
                       + CASE WHEN c2.n >= 2 THEN ln(c2.n / h1.n)
                              ELSE CASE WHEN p.w2 IS NULL THEN 0.0::DOUBLE ELSE ln(0.4::DOUBLE) END + ln(c1.n / (SELECT n FROM total))
                         END END AS l
      FROM p JOIN c1 ON c1.w1 = p.w1 LEFT JOIN c2 ON c2.w2 = p.w2 LEFT JOIN c3 ON c3.w3 = p.w3
      LEFT JOIN c1 h1 ON h1.w1 = p.w2[1] LEFT JOIN c2 h2 ON h2.w2 = p.w3[1:2]),
sums AS (SELECT r, count(*) FILTER (whole) AS n_full, sum(l) AS l FROM s GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_full, 0) AS n_full, round(l, 3) AS log_score,
       round(l / len(w), 6) AS mean_log_score
FROM d LEFT JOIN sums USING (r)
"""

# All pairs of sets that share an n-gram, with the exact similarity.
_NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5
               THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))
               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END)) AS grams FROM d),
s AS (SELECT doc_id, len(grams) AS n, grams, CASE WHEN len(grams) > 0 THEN md5(array_to_string(grams, '|')) ELSE doc_id::VARCHAR END AS key FROM g),
c AS (SELECT key, min(doc_id) AS copy_id, count(*) AS n_copies, any_value(grams) AS grams, any_value(n) AS n FROM s GROUP BY key),
e AS (SELECT copy_id, n, unnest(grams) AS gram FROM c),
links AS (SELECT a.copy_id AS a, b.copy_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.copy_id <> b.copy_id
          GROUP BY a.copy_id, b.copy_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
reach AS (SELECT copy_id AS node, copy_id AS seen FROM c UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
classes AS (SELECT node, min(seen) AS class_id FROM reach GROUP BY node),
degrees AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT s.doc_id, class_id, c.copy_id, n_copies, coalesce(n_links, 0) AS n_links, s.n AS n_grams
FROM s JOIN c USING (key) JOIN classes ON node = c.copy_id LEFT JOIN degrees ON a = c.copy_id
"""

# Four equal parts of integer components; one CTE per Lloyd round. Entries without a part keep their place.
def _lloyd(rounds: int) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, part, entry, far FROM (
    SELECT vec_id, part, entry, far, row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) AS n
    FROM (SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS far
          FROM pieces p JOIN book{r} b ON p.part = b.part AND p.pos = b.pos GROUP BY p.vec_id, p.part, b.entry))
  WHERE n = 1)""")
        if r < rounds:
            steps.append(f"""
mean{r} AS (SELECT n.part, n.entry, p.pos, sum(p.x)::HUGEINT AS s, count(*) AS c
            FROM near{r} n JOIN pieces p ON p.vec_id = n.vec_id AND p.part = n.part GROUP BY n.part, n.entry, p.pos),
book{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos,
         CASE WHEN c IS NULL THEN b.x ELSE ((s - ((s % c) + c) % c) // c)::BIGINT END AS x
  FROM book{r} b LEFT JOIN mean{r} m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos)""")
    return ",".join(steps)


_CODES = f"""
WITH kept AS (
  SELECT vec_id, label, embedding, len(embedding) // 4 AS side FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (
  SELECT vec_id, ((i - 1) // side) AS part, ((i - 1) % side) AS pos, floor(1024 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM kept, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i)),
start AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),
book0 AS MATERIALIZED (SELECT part, entry, pos, x FROM pieces JOIN start USING (vec_id)),
{_lloyd(4)},
codes AS (SELECT vec_id, string_agg(lower(printf('%02x', entry::INTEGER)), '' ORDER BY part) AS code, sum(far)::BIGINT AS error
          FROM near4 GROUP BY vec_id),
printed AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) AS sha FROM book4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha FROM printed) AS codebooks_sha256
FROM kept JOIN codes USING (vec_id)
"""

# DuckDB has no CRC-32: the table of its 256 steps, folded over the bytes of each distinct word.
_SAMPLE = f"""
WITH steps AS (
  SELECT list_transform(range(256), lambda b: list_reduce(
           list_concat([b::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
           lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT {_WORDS} AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS word FROM d),
iw AS (SELECT unnest(w) AS word FROM i),
words AS (SELECT DISTINCT word FROM dw UNION SELECT DISTINCT word FROM iw),
hashed AS (
  SELECT word, xor(list_reduce(
           list_concat([4294967295::BIGINT],
                       list_transform(range(1, len(h), 2), lambda k: ('0x' || substr(h, k, 2))::BIGINT)),
           lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS h FROM words), steps),
ds AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
bt AS (SELECT bucket, count(*) AS t FROM iw JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM ds) + 10000))::DOUBLE
                / ((s + 1) * (coalesce((SELECT sum(t) FROM bt), 0) + 10000))::DOUBLE))::BIGINT AS g
         FROM ds LEFT JOIN bt USING (bucket)),
sums AS (SELECT r, count(*) AS n, sum(g)::BIGINT AS g FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
s AS (SELECT r, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
             ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
      FROM d LEFT JOIN sums USING (r)),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM s),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
       CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM z LEFT JOIN ranked USING (r)
"""

_LINES = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, k, lines[k] AS line,
             translate(trim(lines[k], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM d, LATERAL (SELECT unnest(generate_series(1, len(lines))) AS k)),
common AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT r, k, line, common.key IS NOT NULL AND l.doc_id <> last AS gone FROM l LEFT JOIN common ON l.key = common.key),
g AS (SELECT r, count(*) FILTER (gone) AS n_dropped, string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone) AS kept
      FROM f GROUP BY r)
SELECT doc_id, len(lines) AS n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d JOIN g USING (r)
"""

SQL = {
    "op1_lm_score": _BACKOFF,
    "op2_exact_dedup": _DEDUP,
    "op3_ngram_join": _NEAR,
    "op6_license_scan": _LICENSES,
    "op7_url_filter": _URLS,
    "op9_mix_sources": _MIX,
    "op10_decontaminate": _LEAKS,
    "op11_vector_codes": _CODES,
    "op12_importance_resample": _SAMPLE,
    "op13_line_dedup": _LINES,
}
