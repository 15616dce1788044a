"""The rows of the newer queries in DuckDB's SQL."""

WORDS = r"[^\x20\x09-\x0D]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: CRC-32 of a number's digits, a byte and then a bit at a time.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP11_SQL = rf"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words, coalesce({CRC}, 1) AS h FROM documents
), sized AS (
  SELECT *, len(words) AS n, h // 10 AS g, h % 10 = 0 AND len(words) > 0 AS made FROM texts
), placed AS (
  SELECT *, CASE WHEN made THEN g % n ELSE n END AS a FROM sized
), turned AS (
  SELECT row, doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: words[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1 AS BIGINT)]) ELSE words END AS words
  FROM placed
), w AS (
  SELECT row, n, unnest(words) AS word, unnest(range(n)) AS i FROM turned WHERE n >= 24
), same AS (
  SELECT x.row, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT row, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM same) GROUP BY row, q, island
), runs AS (
  SELECT row, start, length, min(q) AS period FROM stretches WHERE length >= greatest(24, 3 * q) GROUP BY row, start, length
), dropped AS (
  SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs
), whole AS (
  SELECT row, unnest(words) AS word, unnest(range(n)) AS i FROM turned
), kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY i) AS text FROM whole ANTI JOIN dropped USING (row, i) GROUP BY row
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY row ORDER BY length::DOUBLE / period DESC, start, period) = 1
), said AS (
  SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS text FROM runs GROUP BY row
)
SELECT t.doc_id, coalesce(s.n_runs, 0) AS n_runs, b.start, CAST(b.length AS BIGINT) AS length, CAST(b.period AS BIGINT) AS period, CAST(1000 * b.length // b.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(s.text, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM turned t LEFT JOIN said s USING (row) LEFT JOIN best b USING (row) LEFT JOIN kept k USING (row)
"""

OP12_SQL = rf"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{WORDS}') AS words FROM documents
), shingled AS (
  SELECT row, doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END)) AS own
  FROM texts
), classes AS (
  SELECT own, len(own) AS n, min(doc_id) AS rep, row_number() OVER () AS class FROM shingled WHERE len(own) > 0 GROUP BY own
), members AS (
  SELECT class, n, unnest(own) AS shingle FROM classes WHERE rep IS NOT NULL
), links AS (
  SELECT x.class AS u, y.class AS v FROM members x JOIN members y ON x.shingle = y.shingle AND x.class < y.class AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n)
  GROUP BY x.class, y.class, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), linked AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reached AS (
  SELECT DISTINCT u AS class, u AS other FROM linked UNION SELECT r.class, b.v FROM reached r JOIN linked b ON b.u = r.other
), least_of AS (
  SELECT r.class, min(c.rep) AS component FROM reached r JOIN classes c ON c.class = r.other GROUP BY r.class
)
SELECT s.doc_id, CAST(len(s.own) AS BIGINT) AS n_shingles, CASE WHEN s.doc_id IS NULL OR len(s.own) = 0 THEN s.doc_id ELSE coalesce(l.component, c.rep) END AS component_id
FROM shingled s LEFT JOIN classes c ON c.own = s.own LEFT JOIN least_of l ON l.class = c.class
"""

TERMS = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"

OP13_SQL = rf"""
WITH found AS (
  SELECT row, doc_id, unnest(regexp_extract_all({LOWER.format("text")}, '{TERMS}')) AS term FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)
), tfs AS (
  SELECT row, doc_id, term, count(*) AS tf FROM found GROUP BY row, doc_id, term
), lengths AS (
  SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY row
), total AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, total GROUP BY term
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER.format("text")}, '{TERMS}')) AS term FROM benchmark WHERE item_id IS NOT NULL
), scores AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM items JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (row), total GROUP BY item_id, row, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
