"""Named queries of row clean-up and statement statistics, with their SQL for DuckDB.

The derived ledger has tidy rows only, so some queries first spoil them by rules that both dialects share.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.functions.money import to_minor
from ledgerlark.operators import cleaning, statistics
from ledgerlark.operators.corrections import correct_categories

from .queries import _CATEGORY, ORACLE_SQL, QUERIES, add

_SIGNED = "CASE WHEN row_idx % 5 IN (0, 2) THEN -debit ELSE debit END AS debit, CASE WHEN row_idx % 7 IN (1, 3) THEN -credit ELSE credit END AS credit"
_NOISY = "concat('  ', description, CASE WHEN row_idx % 3 = 0 THEN '  oww' ELSE ' XOWW' END, CASE WHEN row_idx % 4 = 0 THEN ' HIJTON MARRIOITT ' ELSE '' END) AS description"
_SPOILT = """statement_id, row_idx, debit, credit, balance,
  CASE WHEN row_idx % 6 = 0 THEN '' WHEN row_idx % 6 = 1 THEN 'Unknown' WHEN row_idx % 6 = 2 THEN '3/12/24' WHEN row_idx % 6 = 3 THEN '5 Mar 2024' ELSE date END AS date,
  CASE WHEN row_idx % 8 = 0 THEN 'Opening Balance' WHEN row_idx % 8 = 1 THEN '  ' ELSE description END AS description"""
_TIDY = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


def _repaired(x: str) -> str:
    for wrong, right in cleaning.REPAIRS:
        x = f"regexp_replace({x}, '(?i)\\b{wrong}\\b', '{right}', 'g')"
    return _TIDY.format(x)


add(
    "normalized_amounts",
    lambda df: cleaning.normalize_signs(df.selectExpr("statement_id", "row_idx", *_SIGNED.replace(" AS debit, ", " AS debit|").split("|"))),
    f"""SELECT statement_id, row_idx, CASE WHEN debit < 0 AND credit <= 0 THEN 0 WHEN credit < 0 AND debit <= 0 THEN abs(credit) ELSE abs(debit) END AS debit,
       CASE WHEN debit < 0 AND credit <= 0 THEN abs(debit) WHEN credit < 0 AND debit <= 0 THEN 0 ELSE abs(credit) END AS credit
       FROM (SELECT statement_id, row_idx, {_SIGNED} FROM ledger)""",
)
add(
    "repaired_descriptions",
    lambda df: df.selectExpr("statement_id", "row_idx", _NOISY).withColumn("description", cleaning.repair_text(F.col("description"))),
    f"SELECT statement_id, row_idx, {_repaired(_TIDY.format('description'))} AS description FROM (SELECT statement_id, row_idx, {_NOISY} FROM ledger)",
)
_SPOILT_COLUMNS = ["statement_id", "row_idx", "debit", "credit", "balance", *[x.strip() for x in _SPOILT.split("balance,", 1)[1].split("AS date,")]]
_SPOILT_COLUMNS[5] += " AS date"
add(
    "transaction_rows",
    lambda df: cleaning.transactions_only(df.selectExpr(*_SPOILT_COLUMNS)).select("statement_id", "row_idx", "date", "description"),
    f"""SELECT statement_id, row_idx, date, description FROM (SELECT {_SPOILT} FROM ledger) WHERE (debit <> 0 OR credit <> 0)
       AND (regexp_matches(trim(date), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') OR regexp_matches(date, '\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}')
            OR regexp_matches(lower(date), '\\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)\\b'))""",
)
add(
    "accepted_rows",
    lambda df: cleaning.accepted(df.selectExpr(*_SPOILT_COLUMNS)).select("statement_id", "row_idx", "date", "description"),
    f"""SELECT statement_id, row_idx, date, description FROM (SELECT {_SPOILT} FROM ledger)
       WHERE trim(date) <> '' AND date <> 'Unknown' AND trim(description) <> '' AND coalesce(debit, credit, balance) IS NOT NULL""",
)
add(
    "narration_keys",
    lambda df: df.select("statement_id", "row_idx", cleaning.narration_key(F.concat_ws(" ", "description", "ref_number")).alias("narration_key")),
    rf"""SELECT statement_id, row_idx, substr({_TIDY.format(rf"regexp_replace(regexp_replace(regexp_replace(lower(concat(description, ' ', ref_number)), '[a-z]*[0-9]+[a-z0-9]*', ' ', 'g'), '\b(?:{cleaning.RAILS})\b', ' ', 'g'), '[^a-z\s]', ' ', 'g')")}, 1, 72) AS narration_key
       FROM ledger""",
)
add(
    "credit_statistics",
    statistics.amount_statistics,
    """SELECT statement_id, count(*) AS n_amounts, median(credit)::DOUBLE AS median, round(CASE WHEN count(*) <= 1 THEN 0 ELSE stddev_pop(credit) END, 2) AS deviation,
       round(CASE WHEN count(*) <= 1 THEN 0 ELSE stddev_pop(credit) / avg(credit) END, 6) AS variation,
       round(CASE WHEN count(*) >= 5 THEN (sum(credit) - min(credit) - max(credit))::DOUBLE / (count(*) - 2) ELSE avg(credit) END, 4) AS robust_mean
       FROM ledger WHERE credit > 0 GROUP BY statement_id""",
)
add(
    "low_balance_share",
    statistics.low_balance_frequency,
    """SELECT statement_id, round(any_value(threshold), 4) AS threshold, count(*) FILTER (WHERE balance <= threshold)::DOUBLE / count(*) AS low_share FROM (
         SELECT *, coalesce(greatest(100000::DOUBLE, 0.12::DOUBLE * median(balance) FILTER (WHERE balance > 0) OVER (PARTITION BY statement_id)), 100000::DOUBLE) AS threshold FROM ledger)
       GROUP BY statement_id""",
)
add(
    "cash_withdrawal_share",
    statistics.cash_share,
    f"""SELECT statement_id, CASE WHEN sum(debit) > 0 THEN sum(debit) FILTER (WHERE regexp_matches(lower(description), '{"|".join(statistics.CASH)}') OR {_CATEGORY} = 'Cash')::DOUBLE
       / sum(debit) ELSE 0.0::DOUBLE END AS cash_share FROM ledger GROUP BY statement_id""".replace("= 'Cash')::DOUBLE", "= 'Cash')").replace("sum(debit) FILTER", "coalesce(sum(debit) FILTER").replace("= 'Cash')\n", "= 'Cash'), 0)::DOUBLE\n"),
)
_GROWTH = (1 + statistics.RATE / 12) ** statistics.MONTHS
add(
    "instalment_principal",
    statistics.instalments,
    f"""SELECT statement_id, row_idx, debit, round(debit * {(_GROWTH - 1) / (statistics.RATE / 12 * _GROWTH)!r}::DOUBLE, 2) AS principal
       FROM ledger WHERE {_CATEGORY} = 'Loan/EMI' AND debit > 0""",
)
add(
    "direction_mismatch",
    statistics.direction_mismatch,
    """SELECT *, least(forward, reversed) AS mismatch_ratio FROM (
       SELECT statement_id, coalesce(count(*) FILTER (WHERE abs(balance - (b + credit - debit)) > 1)::DOUBLE / nullif(count(b), 0), 0.0::DOUBLE) AS forward,
       coalesce(count(*) FILTER (WHERE abs(balance - (a + credit - debit)) > 1)::DOUBLE / nullif(count(a), 0), 0.0::DOUBLE) AS reversed
       FROM (SELECT *, lag(balance) OVER w AS b, lead(balance) OVER w AS a FROM ledger WINDOW w AS (PARTITION BY statement_id ORDER BY row_idx)) GROUP BY statement_id)""",
)
add(
    "date_order",
    statistics.date_order,
    """SELECT statement_id, coalesce(least(count(*) FILTER (WHERE s < 0), count(*) FILTER (WHERE s > 0))::DOUBLE / nullif(count(s), 0), 0.0::DOUBLE) AS violation_ratio,
       coalesce(greatest(count(*) FILTER (WHERE s BETWEEN -2 AND 45), count(*) FILTER (WHERE s BETWEEN -45 AND 2))::DOUBLE / nullif(count(s), 0), 1.0::DOUBLE) AS continuity
       FROM (SELECT statement_id, date::DATE - lag(date::DATE) OVER (PARTITION BY statement_id ORDER BY row_idx) AS s FROM ledger) GROUP BY statement_id""",
    kind="orders",
)
QUERIES["minor_units"] = lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", to_minor(F.col("o_totalprice") / 7).alias("minor"))
ORACLE_SQL["minor_units"] = "SELECT o_orderkey, CAST(floor((o_totalprice / 7 + 2.220446049250313e-16::DOUBLE) * 100 + 0.5) AS BIGINT) AS minor FROM orders"
#: Corrections that users' rows suggest: parts of narrations of every length, and whole ones.
_CORRECTIONS = """SELECT DISTINCT lower(CASE WHEN row_idx % 4 = 0 THEN description ELSE substr(description, CAST(row_idx % 7 + 1 AS INT), CAST(row_idx % 6 AS INT)) END) AS pattern,
  concat('Corrected ', row_idx % 9) AS category, row_idx % 50 AS priority FROM {0} WHERE statement_id % 40 = 3"""


def _corrected(df):
    known = df.sparkSession.sql(_CORRECTIONS.format("{ledger}"), ledger=df)
    return correct_categories(df.select("statement_id", "row_idx", "description", F.lit("Known").alias("category")), known).select("statement_id", "row_idx", "corrected_category")


add(
    "corrected_categories",
    _corrected,
    f"""SELECT l.statement_id, l.row_idx, coalesce(label, 'Known') AS corrected_category FROM ledger l LEFT JOIN (
      SELECT t, arg_min(category, ROW(NOT pattern = t, priority, pattern, category)) AS label FROM (SELECT DISTINCT lower(description) AS t FROM ledger) JOIN ({_CORRECTIONS.format("ledger")}) ON pattern <> '' AND contains(t, pattern) GROUP BY t)
    ON t = lower(description)""",
)
