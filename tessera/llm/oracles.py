"""SQL that gives the rows of those queries that SQL can express."""

#: The same mix: keys from an md5, prefix sums over whole sources.
OP9 = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), keyed AS (
  SELECT doc_id, source, size,
    round(-ln((('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
      / round(0.1::DOUBLE + 0.9::DOUBLE * least(size / 200.0::DOUBLE, 1.0::DOUBLE)
        * (1 - len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) / greatest(length(coalesce(text, '')), 1)::DOUBLE), 6), 9) AS key
  FROM sized
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source
), ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT) + 1] AS weight FROM sources
), levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS "full", 2.0::DOUBLE * source_size / weight AS "at", 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM ranked
), opened AS (
  SELECT *, coalesce(sum("full") OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS "open"
  FROM levels WINDOW w AS (ORDER BY "at", source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), leveled AS (
  SELECT *, (SELECT (budget - capped) / "open" FROM opened WHERE capped + "at" * "open" >= budget ORDER BY "at", source ASC NULLS LAST LIMIT 1) AS level FROM opened
), aims AS (
  SELECT source, source_size, least("full", coalesce(level, 'infinity'::DOUBLE) * weight) AS target FROM leveled
), planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM aims
), summed AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(k.size) OVER (PARTITION BY k.source, k.key, k.doc_id, k.size) AS tied
  FROM keyed k JOIN planned p ON k.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (epochs + CASE WHEN upto - tied / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed
"""

#: Exact similarities over shingles that two documents share; components by reachability.
OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * common >= 80 * (x.n + y.n - common)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.seen
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, r.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1) r ON r.node = d.doc_id
"""

#: The counts that the base rule rests on; which outliers a robust estimate finds is beyond SQL.
COUNTS = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 5], ' ') AS x FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 0))) AS i FROM texts)
), again AS (
  SELECT doc_id, unnest(places) AS i FROM (SELECT doc_id, x, list(i) AS places FROM windows GROUP BY 1, 2 HAVING count(*) > 1)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(5)) AS k) GROUP BY 1
), lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts
)
SELECT t.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(c.n, 0) > 20 * len(w) AS base_failed
FROM texts t JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)
"""

#: Every 100-byte string by its digits; those that aren't the first of their kind cover what goes.
OP6 = r"""
WITH texts AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), strings AS (
  SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS s FROM (SELECT doc_id, h, unnest(range(greatest(n - 99, 0))) AS i FROM texts)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM strings) WHERE r > 1
), starts AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM later
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM starts) GROUP BY doc_id, g
), kept AS (
  SELECT t.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
    string_agg(substr(h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS k
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans) s JOIN texts t ON t.doc_id = s.doc_id GROUP BY t.doc_id
)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""

#: What the archives say of each page, from the pages themselves: 160 bits of a SHA-1, five to a digit.
OP8 = r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), firsts AS (
  SELECT html, min(page_id) AS first FROM payloads GROUP BY 1
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM payloads JOIN firsts USING (html)
"""

ORACLES: dict[str, str] = {"op1_near_dedup": OP1, "op6_suffix_dedup": OP6, "op8_warc": OP8, "op9_mixing": OP9, "quality_counts": COUNTS}
