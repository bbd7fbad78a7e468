"""What DuckDB says to the operators that SQL can express, on whole tables."""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
strings AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d) t),
firsts AS (SELECT s, min(doc_id) AS low FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM strings JOIN firsts USING (s) WHERE doc_id > low),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t
         FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) x ANTI JOIN hits USING (doc_id, p)
         GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id"""

OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, k, n, substr(h, 200 * k + 1, 400) AS b
           FROM (SELECT doc_id, h, CAST(length(h) / 2 AS BIGINT) AS n, unnest(range(0, CAST(length(h) / 200 AS BIGINT) + 1)) AS k FROM d) t),
strings AS (SELECT doc_id, 100 * k + o AS i, substr(b, 2 * o + 1, 200) AS s
            FROM (SELECT doc_id, k, n, b, unnest(range(0, 100)) AS o FROM blocks) t WHERE 100 * k + o + 100 <= n),
firsts AS (SELECT s, min((doc_id, i)) AS low FROM strings GROUP BY s HAVING count(*) > 1),
late AS (SELECT doc_id, i FROM strings JOIN firsts USING (s) WHERE (doc_id, i) > low),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new
           FROM late),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 100 AS b
          FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) t GROUP BY doc_id, k),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
         UNION ALL SELECT doc_id, coalesce(max(b), 0), NULL FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN b IS NULL THEN substr(h, CAST(2 * a + 1 AS BIGINT))
                                        ELSE substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)) END, '' ORDER BY a) AS t
         FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, count(*) AS n, sum(b - a) AS bytes FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(bytes, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(t)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)"""

_ITEM_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP4 = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ITEM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
windows AS (SELECT DISTINCT item, array_to_string(list_slice(w, i, i + 9), ' ') AS s, least(len(w), 10) AS n
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0) t),
sizes AS (SELECT DISTINCT n FROM windows),
strings AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
            FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM d, sizes WHERE len(w) >= n) t),
found AS (SELECT doc_id, i, n, item FROM strings JOIN windows USING (s, n)),
hits AS (SELECT doc_id, count(DISTINCT p) AS hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) t GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS k, string_agg(item, ',' ORDER BY item) AS t
          FROM (SELECT DISTINCT doc_id, item FROM found) t GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(k, 0) AS BIGINT) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS s
             FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0) t),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT s FROM shingles GROUP BY s HAVING count(*) > 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
          FROM (SELECT * FROM shingles SEMI JOIN shared USING (s)) a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT r.a, l.b FROM reached r JOIN both_ways l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) c USING (doc_id)"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
sums AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d WHERE len(t) > 0),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) x),
tf AS (SELECT doc_id, n, term, count(*) AS tf
       FROM (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) x SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(n_docs AS DOUBLE) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM tf, sums GROUP BY term, n_docs),
impacts AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)) AS i FROM tf, sums),
scores AS (SELECT item_id, doc_id, CAST(sum(w * i) AS BIGINT) AS score
           FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) r
WHERE rank <= 10"""

# CRC-32 of distinct words, byte by byte, over a table of 256 made by the rule.
OP13 = f"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                         ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
target AS (SELECT unnest({_TERMS}) AS word FROM benchmark),
words AS (SELECT doc_id, unnest(w) AS word FROM d),
known AS (SELECT DISTINCT word FROM (SELECT word FROM words UNION ALL SELECT word FROM target) x),
hashed AS (SELECT word, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
                  list_transform(range(CAST(length(hex(encode(word))) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT))),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket FROM known, crc),
s AS (SELECT bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN hashed USING (word) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (CAST((SELECT sum(n) FROM s) AS DOUBLE) + 10000)
                                            / ((s.n + 1) * (CAST((SELECT coalesce(sum(n), 0) FROM t) AS DOUBLE) + 10000)))) AS BIGINT) AS gain
          FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT doc_id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
            FROM words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scores AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(
                  -1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
           FROM d LEFT JOIN weights USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS wanted
          FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank
FROM scores LEFT JOIN drawn USING (doc_id)"""

ORACLE_SQL = {
    "op1_substring_dedup": OP1,
    "op3_suffix_dedup": OP3,
    "op4_decontamination": OP4,
    "op5_ngram_jaccard": OP5,
    "op11_lexical_search": OP11,
    "op13_importance_resampling": OP13,
}
