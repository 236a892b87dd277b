"""Named queries of repeats, matches and merges of statements, with SQL for DuckDB where it can follow the order of choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import matching, merging
from ledgerlark.operators.adjacent import renumber
from ledgerlark.sources.ledger import ledger, ledger_sql

from .dates import _PARTS, _YEAR_FIRST, _YEAR_LAST, RAW
from .queries import ORACLE_SQL, QUERIES
from .repairs import add_spoilt

#: Few dates, amounts and balances, so that rows repeat, with narrations that contain each other.
COARSE = [
    "statement_id", "row_idx", "substr(date, 1, 7) AS date", "concat(CASE WHEN row_idx % 5 < 2 THEN 'UPI' ELSE description END, CASE row_idx % 4 WHEN 1 THEN ' paid.' WHEN 2 THEN ' paid at the shop' ELSE '' END) AS description",
    "CASE row_idx % 6 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'A 1' ELSE concat('R', row_idx % 4) END AS ref_number",
    "debit % 2 * 100 AS debit", "credit % 2 * 100 AS credit", "balance % 3 * 100 AS balance",
]
add_spoilt(
    "best_of_repeats",
    COARSE,
    lambda df: matching.best_of_repeats(df).select("statement_id", "row_idx", "position"),
    r"""SELECT statement_id, last.row_idx AS row_idx, position FROM (
      SELECT statement_id, position, list_reduce(list_sort(list({'row_idx': row_idx, 'w': w})), lambda a, b : CASE WHEN length(b.w) > length(a.w) AND contains(b.w, a.w) THEN b ELSE a END) AS last
      FROM (SELECT *, min(row_idx) OVER k AS position, max(q) OVER k AS top FROM (
        SELECT *, trim(regexp_replace(lower(description), '[^a-z0-9]+', ' ', 'g')) AS w, least(length(trim(description)), 80) + CASE WHEN ref <> '' THEN least(length(ref), 24) + 6 ELSE 0 END
          + CASE WHEN regexp_matches(ref, '[A-Za-z]') AND regexp_matches(ref, '[0-9]') THEN 10 ELSE 0 END - CASE WHEN length(ref) - length(replace(ref, ' ', '')) > 2 THEN 8 ELSE 0 END
          - CASE WHEN len(regexp_split_to_array(trim(description), '\s+')) <= 4 THEN 6 ELSE 0 END AS q
        FROM (SELECT *, trim(coalesce(ref_number, '')) AS ref FROM ledger)) WINDOW k AS (PARTITION BY statement_id, date, debit, credit, balance))
      WHERE q = top GROUP BY statement_id, position)""",
)


def likely_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = matching.drop_likely_repeats(ledger(spark, sf_dir, "orders").selectExpr(*COARSE))
    return kept.select("statement_id", "row_idx", "kept_row", "date", "description", "ref_number")


def merged_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger and a second reading of it, which lacks rows, has others, and is off in balances and words."""
    rows = ledger(spark, sf_dir, "orders").select("statement_id", "row_idx", "date", "description", "ref_number", "debit", "credit", "balance")
    second = rows.where("row_idx % 10 <> 3").selectExpr(
        "statement_id", "row_idx", "CASE WHEN row_idx % 31 = 4 THEN '' ELSE date END AS date", "CASE WHEN row_idx % 3 = 0 THEN concat(description, ' in full words') ELSE description END AS description", "ref_number",
        "CASE WHEN row_idx % 9 = 1 THEN credit ELSE debit END AS debit", "CASE WHEN row_idx % 9 = 1 THEN debit ELSE credit END AS credit", "balance + row_idx % 5 * 60 AS balance",
    )
    first = rows.where("row_idx % 12 <> 5")
    return matching.merge_extractions(renumber(first), renumber(second))


#: Each choice depends on those before it: these are tested against plain loops.
QUERIES |= {"likely_repeats": likely_repeats, "merged_extractions": merged_extractions}

_FILES = [
    "statement_id % 10 AS group_id", "statement_id div 10 AS file_idx", "row_idx", RAW[2], "ref_number", "debit", "credit", "CASE WHEN row_idx % 19 = 6 THEN NULL ELSE balance END AS balance",
]
_HEADS = """SELECT DISTINCT statement_id % 10 AS group_id, {div} AS file_idx, concat('file', {div}, '.pdf') AS file_name,
  CASE WHEN {div} = 0 AND statement_id % 3 = 1 THEN '  ' WHEN statement_id % 17 = 5 THEN 'Other Bank' WHEN statement_id % 2 = 0 THEN 'ACME Bank Ltd.' ELSE ' acme bank LTD' END AS bank_name,
  CASE WHEN statement_id % 23 = 8 THEN NULL ELSE concat('00-', statement_id % 10, CASE WHEN {div} % 2 = 0 THEN '-7' ELSE '7' END) END AS account_number,
  CASE WHEN statement_id % 19 = 4 THEN 'usd' ELSE 'I N R' END AS currency, CASE WHEN {div} < 2 THEN '' ELSE concat('Holder ', {div}) END AS account_holder,
  CASE statement_id % 4 WHEN 0 THEN '01/02/1997 - 03/05/1999' WHEN 1 THEN 'April 1998 - December 2001' WHEN 2 THEN concat('from 1996-01-01 to 200', {div}, '-02-31') ELSE 'soon' END AS statement_period,
  CASE WHEN statement_id % 3 = 0 THEN NULL ELSE statement_id * 1000 END AS closing_balance FROM {source}"""


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = ledger(spark, sf_dir, "orders")
    return rows.selectExpr(*_FILES), spark.sql(_HEADS.replace("{div}", "statement_id div 10"), source=rows)


_VIEWS = [
    f"plain AS MATERIALIZED ({ledger_sql('orders', 'varchar')})", f"ledger AS (SELECT {', '.join(RAW)} FROM plain)", _PARTS,
    """lines AS (SELECT statement_id % 10 AS group_id, statement_id // 10 AS file_idx, row_idx, l.date, ref_number, debit, credit, CASE WHEN row_idx % 19 = 6 THEN NULL ELSE balance END AS balance
  FROM plain JOIN ledger l USING (statement_id, row_idx))""",
    f"heads AS ({_HEADS.replace('{div}', 'statement_id // 10').replace('{source}', 'plain')})",
    f"""numbers AS (SELECT l.*, TRY_CAST(n[1] AS INT) AS a, TRY_CAST(n[2] AS INT) AS b, TRY_CAST(n[3] AS INT) AS c, n FROM (
      SELECT *, [{', '.join(rf"regexp_extract(trim(date), '^(\d{{1,4}})[/-](\d{{1,2}})[/-](\d{{1,4}})', {i})" for i in (1, 2, 3))}] AS n FROM lines) l)""",
    f"""merged AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY day NULLS LAST, file_idx, file_row) - 1 AS row_idx FROM (
      SELECT n.group_id, n.file_idx, n.row_idx AS file_row, n.date, ref_number, debit, credit, balance, CAST(CASE WHEN a IS NULL THEN d.day WHEN length(n[1]) = 4 THEN {_YEAR_FIRST} ELSE {_YEAR_LAST} END AS DATE) AS day
      FROM numbers n LEFT JOIN days d ON d.statement_id = n.file_idx * 10 + n.group_id AND d.row_idx = n.row_idx))""",
]


def _add(name: str, build, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(*_files(spark, sf_dir))
    ORACLE_SQL[name] = f"WITH {', '.join(_VIEWS)} {sql}"


_add(
    "merged_rows",
    lambda rows, heads: merging.merge_rows(rows).select("statement_id", "row_idx", "file_idx", "file_row", "date", "day"),
    "SELECT group_id AS statement_id, row_idx, file_idx, file_row, date, day FROM merged",
)
_FIRST = "arg_min(trim({0}), file_idx) FILTER (trim({0}) <> '') AS {0}"
_add(
    "merge_eligibility",
    lambda rows, heads: merging.merge_eligibility(heads).withColumn("reasons", F.concat_ws("; ", "reasons")),
    rf"""SELECT group_id, reasons = '' AS can_merge, reasons, bank_name, account_number, currency, account_holder FROM (
      SELECT group_id, array_to_string(list_concat(CASE WHEN count(*) < 2 THEN ['Only one statement uploaded'] ELSE [] END, flatten(list(r ORDER BY file_idx))), '; ') AS reasons,
        {', '.join(f'any_value({c}) AS {c}' for c in merging.DISPLAYED)} FROM (
        SELECT h.group_id, file_idx, f.* EXCLUDE (group_id), list_filter([
          CASE WHEN coalesce(h.bank_name, '') = '' THEN 'Missing bank name in ' || file_name WHEN regexp_replace(lower(h.bank_name), '[^a-z0-9]', '', 'g') <> regexp_replace(lower(coalesce(f.bank_name, '')), '[^a-z0-9]', '', 'g') THEN 'Bank name mismatch in ' || file_name END,
          CASE WHEN coalesce(h.account_number, '') = '' THEN 'Missing account number in ' || file_name WHEN regexp_replace(h.account_number, '[^0-9]', '', 'g') <> regexp_replace(f.account_number, '[^0-9]', '', 'g') THEN 'Account number mismatch in ' || file_name END,
          CASE WHEN upper(replace(h.currency, ' ', '')) <> upper(replace(f.currency, ' ', '')) THEN 'Currency mismatch in ' || file_name END], lambda x : x IS NOT NULL) AS r
        FROM heads h JOIN (SELECT group_id, {', '.join(_FIRST.format(c) for c in merging.DISPLAYED)} FROM heads GROUP BY group_id) f USING (group_id)) GROUP BY group_id)""",
)
_FINAL = """SELECT group_id, arg_max({'b': coalesce(closing_balance, last_balance.b)}, {'known': ended IS NOT NULL, 'ended': coalesce(ended, DATE '0001-01-01'), 'file_idx': file_idx}).b AS final_balance FROM (
  SELECT h.group_id, h.file_idx, closing_balance, last_balance, CASE statement_id_4 WHEN 0 THEN DATE '1999-05-03' WHEN 1 THEN DATE '2001-12-01' WHEN 2 THEN make_date(2000 + h.file_idx, 2, 1) + 30 ELSE last_day END AS ended
  FROM (SELECT *, (file_idx * 10 + group_id) % 4 AS statement_id_4 FROM heads) h LEFT JOIN (
    SELECT group_id, file_idx, max(day) AS last_day, arg_max({'b': balance}, {'day': day, 'row_idx': file_row}) AS last_balance FROM merged WHERE day IS NOT NULL GROUP BY ALL) l USING (group_id, file_idx)) GROUP BY group_id"""
_add(
    "merge_summary",
    merging.merge_summary,
    f"""SELECT group_id, n_rows, duplicates, total_debit, total_credit, statement_period, final_balance, bank_name, account_number, currency, account_holder FROM (
      SELECT group_id, count(*) AS n_rows, CAST(sum(debit) AS BIGINT) AS total_debit, CAST(sum(credit) AS BIGINT) AS total_credit,
        arg_min(trim(date), row_idx) FILTER (day IS NOT NULL) || ' to ' || arg_max(trim(date), row_idx) FILTER (day IS NOT NULL) AS statement_period FROM merged GROUP BY group_id)
      JOIN (SELECT group_id, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT group_id, count(*) AS n FROM merged WHERE ref_number <> ''
        GROUP BY group_id, coalesce(trim(date), ''), ref_number, CASE WHEN debit > 0 THEN debit ELSE credit END) GROUP BY group_id) USING (group_id)
      JOIN (SELECT group_id, {', '.join(_FIRST.format(c) for c in merging.DISPLAYED)} FROM heads GROUP BY group_id) USING (group_id) JOIN ({_FINAL}) USING (group_id)""",
)
