"""SQL of op12_resampling: CRC-32 by its table of 256 remainders, made from the polynomial."""

ORACLE = r"""
WITH crc_table AS (
  SELECT list_transform(range(256), lambda i : list_reduce(list_concat([i], range(8)),
    lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
df AS (
  SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (
  SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1]))) AS f FROM b),
dn AS (SELECT rid, f, count(*) AS n FROM df GROUP BY ALL),
bn AS (SELECT f, count(*) AS n FROM bf GROUP BY ALL),
texts AS (SELECT f FROM dn UNION SELECT f FROM bn),
codes AS (
  SELECT f, list_transform(range(1, len(hex(f)) + 1, 2), lambda i : CAST('0x' || substr(hex(f), i, 2) AS BIGINT)) AS bytes FROM texts),
buckets AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x : xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM codes, crc_table),
s AS (SELECT bucket, sum(n) AS s FROM dn JOIN buckets USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bn JOIN buckets USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS su, (SELECT coalesce(sum(t), 0) FROM t) AS tu),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST(su AS DOUBLE) + 10000)
    / ((CAST(s AS DOUBLE) + 1) * (CAST(tu AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket), totals),
sums AS (SELECT rid, sum(n) AS n_features, sum(n * gain) AS total FROM dn JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY rid),
weighed AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features,
    CAST(coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN sums USING (rid)),
scored AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM weighed),
placed AS (
  SELECT *, n_words >= 20 AND score IS NOT NULL AS eligible,
    row_number() OVER (PARTITION BY n_words >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id, n_features) AS place,
    count(*) FILTER (n_words >= 20 AND score IS NOT NULL) OVER () AS n
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""
