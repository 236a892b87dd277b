"""Named queries of the date grammars, over dates that are first written in many ways, with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions import dates
from ledgerlark.operators import statistics

from .repairs import add_spoilt

_NAMES = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
_NAME = "CASE substr(date, 6, 2) " + " ".join(f"WHEN '{i + 1:02}' THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
_Y, _M, _D = "substr(date, 1, 4)", "substr(date, 6, 2)", "substr(date, 9, 2)"
_WAYS = [
    f"concat({_D}, '/', {_M}, '/', {_Y})", f"concat({_D}, '-', {_M}, '-', substr({_Y}, 3, 2))", f"concat({_D}, ' ', substr({_NAME}, 1, 3), ' ', {_Y})",
    f"concat({_NAME}, ' ', {_D}, ', ', {_Y})", f"concat({_NAME}, ' ', {_Y})", f"concat({_Y}, '/', {_M}, '/', {_D})", f"concat('31/', {_M}, '/', {_Y})",
    f"concat({_D}, '/', {_D}, '/', {_Y})", f"concat('  ', {_Y}, '-', {_M}, '-', {_D}, ' 10:30 ')", f"concat({_D}, '/', {_M}, '/', '5', {_D})",
    f"concat({_D}, '-', substr({_NAME}, 1, 3), '-', {_D})", f"concat({_D}, ' Foo ', {_Y})", "'Unknown'", "NULL", f"concat({_D}, {_M}, {_Y})",
    f"concat({_M}, '/', {_D}, '/', {_Y})", f"concat({_D}, {_M}, substr({_Y}, 3, 2))", f"concat({_Y}, {_M}, {_D})", f"concat({_D}, ' ', substr({_NAME}, 1, 3))", "date",
]
#: The ledger's dates written in twenty ways, in turn.
RAW = ["statement_id", "row_idx", "CASE row_idx % 20 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(_WAYS)) + " END AS date"]

_TIDY = r"trim(regexp_replace(date, '\s+', ' ', 'g'))"
_MONTH = "list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(substr({0}, 1, 3)))"
_FORMS = [
    (r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})(?: .*|T.*)?", 3), (r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})", 3), (r"(\d{1,2}) ([A-Za-z]{3,9}),? (\d{2,4})", 3),
    (r"([A-Za-z]{3,9}) (\d{1,2}),? (\d{2,4})", 3), (r"([A-Za-z]{3,9}) (\d{2,4})", 2),
]
_GROUPS = "[" + ", ".join(f"regexp_extract(clean, '^{form}$', {i + 1})" for form, n in _FORMS for i in range(n)) + "]"
_PARTS = rf"""parts AS (
  SELECT *, CASE WHEN f[1] <> '' THEN f[1] WHEN f[6] <> '' THEN f[6] WHEN f[9] <> '' THEN f[9] WHEN f[12] <> '' THEN f[12] ELSE f[14] END AS y,
    CASE WHEN f[2] <> '' THEN CAST(f[2] AS INT) WHEN f[5] <> '' THEN CAST(f[5] AS INT) ELSE {_MONTH.format("concat(f[8], f[10], f[13])")} END AS m,
    CASE WHEN f[13] <> '' THEN 1 ELSE CAST(concat(f[3], f[4], f[7], f[11]) AS INT) END AS d
  FROM (SELECT *, {_GROUPS} AS f FROM (SELECT *, {_TIDY} AS clean FROM ledger)) WHERE concat(f[1], f[4], f[7], f[10], f[13]) <> ''),
dated AS (
  SELECT statement_id, row_idx, CASE WHEN d BETWEEN 1 AND 31 AND m BETWEEN 1 AND 12 THEN printf('%04d-%02d-%02d',
    CASE WHEN length(y) = 2 THEN CASE WHEN CAST(y AS INT) < 50 THEN 2000 ELSE 1900 END ELSE 0 END + CAST(y AS INT), m, d) END AS iso FROM parts),
days AS (
  SELECT statement_id, row_idx, iso, CAST(make_date(CAST(substr(iso, 1, 4) AS INT), CAST(substr(iso, 6, 2) AS INT), 1) + CAST(CAST(substr(iso, 9, 2) AS INT) - 1 AS INT) AS DATE) AS day FROM dated)"""
add_spoilt(
    "normalized_dates",
    RAW,
    lambda df: df.select("statement_id", "row_idx", "date", dates.statement_date(F.col("date")).alias("iso"), dates.statement_day(F.col("date")).alias("day")),
    "SELECT l.statement_id, l.row_idx, l.date, iso, day FROM ledger l LEFT JOIN days d ON d.statement_id = l.statement_id AND d.row_idx = l.row_idx",
    views=(_PARTS,),
)
_NUMERIC = "[" + ", ".join(rf"regexp_extract(trim(date), '^(\d{{1,4}})[/-](\d{{1,2}})[/-](\d{{1,4}})', {i})" for i in range(1, 4)) + "]"
_YEAR_FIRST = "make_date(a, 1, 1) + to_months(b - 1) + to_days(c - 1)"
_YEAR_LAST = """make_date(c + CASE WHEN c < 100 THEN 1900 ELSE 0 END, 1, 1)
  + to_months(CASE WHEN a <= 12 AND b > 12 THEN a ELSE b END - 1) + to_days(CASE WHEN a <= 12 AND b > 12 THEN b ELSE a END - 1)"""
add_spoilt(
    "merge_dates",
    RAW,
    lambda df: df.select("statement_id", "row_idx", dates.merge_day(F.col("date")).alias("day")),
    f"""SELECT l.statement_id, l.row_idx, CAST(CASE WHEN a IS NULL THEN day WHEN length(n[1]) = 4 THEN {_YEAR_FIRST} ELSE {_YEAR_LAST} END AS DATE) AS day FROM (
          SELECT *, TRY_CAST(n[1] AS INT) AS a, TRY_CAST(n[2] AS INT) AS b, TRY_CAST(n[3] AS INT) AS c FROM (SELECT *, {_NUMERIC} AS n FROM ledger)) l
        LEFT JOIN days d ON d.statement_id = l.statement_id AND d.row_idx = l.row_idx""",
    views=(_PARTS,),
)
add_spoilt(
    "packed_dates",
    RAW,
    lambda df: df.select("statement_id", "row_idx", dates.is_packed_date(F.col("date")).alias("is_packed")),
    r"""SELECT statement_id, row_idx, coalesce(CASE WHEN regexp_matches(date, '^\d{8}$') THEN
          (CAST(date[1:4] AS INT) BETWEEN 1990 AND 2099 AND CAST(date[5:6] AS INT) BETWEEN 1 AND 12 AND CAST(date[7:8] AS INT) BETWEEN 1 AND 31)
          OR (CAST(date[5:8] AS INT) BETWEEN 1990 AND 2099 AND CAST(date[3:4] AS INT) BETWEEN 1 AND 12 AND CAST(date[1:2] AS INT) BETWEEN 1 AND 31)
        WHEN regexp_matches(date, '^\d{6}$') THEN (CAST(date[5:6] AS INT) < 50 OR CAST(date[5:6] AS INT) >= 90) AND CAST(date[3:4] AS INT) BETWEEN 1 AND 12 AND CAST(date[1:2] AS INT) BETWEEN 1 AND 31
        END, false) AS is_packed FROM ledger""",
)
add_spoilt(
    "date_grammars",
    RAW,
    lambda df: df.select(
        "statement_id", "row_idx", dates.scanned_date(F.col("date"), F.lit("2024")).alias("scanned"), dates.line_date(F.col("date")).alias("line"),
        dates.line_date(F.col("date"), names_checked=True).alias("batch"), dates.period_day(F.col("date")).alias("period"), dates.ledger_day(F.col("date")).alias("ledger"),
        dates.coded_date(F.col("date")).alias("coded"), dates.embedded_date(F.col("date")).alias("embedded"),
    ),
    "",
)
add_spoilt(
    "date_order_of_raw_dates",
    RAW,
    statistics.date_order,
    """SELECT statement_id, coalesce(least(count(*) FILTER (WHERE s < 0), count(*) FILTER (WHERE s > 0))::DOUBLE / nullif(count(s), 0), 0.0::DOUBLE) AS violation_ratio,
       CASE WHEN count(day) = 0 THEN 0.0::DOUBLE WHEN count(s) = 0 THEN 1.0::DOUBLE
         ELSE greatest(count(*) FILTER (WHERE s BETWEEN -2 AND 45), count(*) FILTER (WHERE s BETWEEN -45 AND 2))::DOUBLE / count(s) END AS continuity
       FROM (SELECT statement_id, day, day - lag(day) OVER (PARTITION BY statement_id ORDER BY row_idx) AS s FROM days WHERE day IS NOT NULL
             UNION ALL SELECT statement_id, NULL, NULL FROM ledger) GROUP BY statement_id""",
    views=(_PARTS,),
)
