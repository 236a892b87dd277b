"""The URL filter query. The tables hold no lists and no fetch days, so both are derived from ids and host names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .url_filters import host, judge

#: Fixed entries of the query's lists: list, kind, pattern, action, day.
FIXED = [
    ("block", "domain", "casino-win.example.com", "add", "2024-02-01"),
    ("block", "domain", "free-bets.example.com", "add", "2024-01-01"),
    ("block", "domain", "free-bets.example.com", "remove", "2024-07-01"),
    ("block", "domain", "cheap-pills.example.com", "add", "2024-04-15"),
    ("allow", "domain", "example.org", "add", "2024-03-01"),
    ("block", "domain", "example.net", "add", "2024-11-01"),
]

#: 0 .. 4095 of a host name h, in both dialects.
_NUMBER = " + ".join(f"{16**k} * (instr('0123456789abcdef', substr(md5(h), {k + 1}, 1)) - 1)" for k in range(3))


def _entries(spark: SparkSession, pages: DataFrame) -> DataFrame:
    fixed = spark.createDataFrame(FIXED, "list string, kind string, pattern string, action string, day string").withColumn("day", F.to_date("day"))
    hosts = pages.select(host(F.col("url")).alias("h")).where("h <> ''").distinct().withColumn("c", F.expr(_NUMBER))
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c") % 200).cast("int"))
    last = F.date_add(first, (30 + F.col("c") % 97).cast("int"))
    event = lambda which, kind, pattern, action, day: hosts.where(which).select(F.lit("block").alias("list"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(action).alias("action"), day.alias("day"))
    return (
        fixed.unionByName(event("c % 4 = 0", "domain", F.col("h"), "add", first))
        .unionByName(event("c % 12 = 0", "domain", F.col("h"), "remove", last))
        .unionByName(event("c % 5 = 0", "prefix", F.concat("h", F.lit("/fr")), "add", last))
    )


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    return judge(pages.withColumn("day", day), _entries(spark, pages))


_FIXED_SQL = ", ".join(f"('{a}', '{b}', '{c}', '{d}', DATE '{e}')" for a, b, c, d, e in FIXED)
ORACLE = f"""
WITH p AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS day,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path,
         row_number() OVER () AS rid
  FROM pages),
hosts AS (SELECT h, {_NUMBER} AS c FROM (SELECT DISTINCT host AS h FROM p WHERE host <> '')),
dated AS (SELECT h, c, DATE '2024-01-01' + CAST(c % 200 AS INTEGER) AS d1, DATE '2024-01-01' + CAST(c % 200 + 30 + c % 97 AS INTEGER) AS d2 FROM hosts),
events(list, kind, pattern, action, day) AS (
  SELECT * FROM (VALUES {_FIXED_SQL})
  UNION ALL SELECT 'block', 'domain', h, 'add', d1 FROM dated WHERE c % 4 = 0
  UNION ALL SELECT 'block', 'domain', h, 'remove', d2 FROM dated WHERE c % 12 = 0
  UNION ALL SELECT 'block', 'prefix', h || '/fr', 'add', d2 FROM dated WHERE c % 5 = 0),
daily AS (SELECT list, kind, pattern, day, max(CASE WHEN action = 'add' THEN 1 ELSE 0 END) AS is_on FROM events GROUP BY ALL),
states AS (SELECT *, coalesce(lag(is_on) OVER (PARTITION BY list, kind, pattern ORDER BY day), 0) AS was FROM daily),
changes AS (SELECT *, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS until FROM states WHERE is_on <> was),
hits AS (
  SELECT rid, c.list, c.pattern FROM p JOIN changes c ON c.is_on = 1 AND c.day <= p.day AND (c.until IS NULL OR p.day < c.until)
   AND CASE WHEN c.kind = 'domain' THEN p.host = c.pattern OR ends_with(p.host, '.' || c.pattern)
       ELSE p.host || p.path = c.pattern OR starts_with(p.host || p.path, c.pattern || '/') END),
best AS (SELECT rid, count(*) AS n, max(ROW(length(pattern), CASE WHEN list = 'block' THEN 1 ELSE 0 END, list, pattern)) AS b FROM hits GROUP BY rid)
SELECT page_id, url, day, host, coalesce(n, 0) AS n_active, coalesce(b[4], '') AS matched, coalesce(b[3], 'none') AS verdict
FROM p LEFT JOIN best USING (rid)
"""
