"""Named ledger queries with equivalent SQL for DuckDB (an independent statement of each, over the same ledger view)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.functions.rules import CATEGORIES, HIGH_RISK, risk_types
from ledgerlark.operators import alerts, analytics, balance
from ledgerlark.sources.ledger import ledger, ledger_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(lower(description), '{p}') THEN '{c}'" for c, p in CATEGORIES) + " ELSE 'Other' END"
_RISKS = {name: f"regexp_matches(lower(description), '{'|'.join(words)}')" for name, words in HIGH_RISK}
_FLAG = "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in reversed(_RISKS.items())) + " END"
_RECONCILED = """rec AS (SELECT *, balance - expected_balance AS difference FROM (
  SELECT *, lag(balance) OVER (PARTITION BY statement_id ORDER BY row_idx) + credit - debit AS expected_balance FROM ledger))"""
_DUPLICATES = """dup AS (SELECT *, n > 1 AND ref_number <> '' AS is_duplicate FROM (
  SELECT *, count(*) OVER k AS n, min(row_idx) OVER k + 1 AS first_row FROM ledger
  WINDOW k AS (PARTITION BY statement_id, date, ref_number, CASE WHEN debit > 0 THEN debit ELSE credit END)))"""


def add(name: str, build: Callable[[DataFrame], DataFrame], sql: str, kind: str = "events", views: tuple[str, ...] = ()) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(ledger(spark, sf_dir, kind))
    ORACLE_SQL[name] = f"WITH {', '.join([f'ledger AS ({ledger_sql(kind, "varchar")})', *views])} {sql}"


add(
    "reconcile_balances",
    lambda df: balance.reconcile(df).where("balance_mismatch").select("statement_id", "row_idx", "expected_balance", "balance", "difference", "severity"),
    """SELECT statement_id, row_idx, expected_balance, balance, difference, CASE WHEN abs(difference) > 1000000 THEN 'critical'
       WHEN abs(difference) > 100000 THEN 'high' WHEN abs(difference) > 10000 THEN 'medium' ELSE 'low' END AS severity
       FROM rec WHERE abs(difference) > 1""",
    views=(_RECONCILED,),
)
add(
    "reconcile_summary",
    lambda df: balance.reconcile_summary(balance.reconcile(df)),
    """SELECT statement_id, n_rows, mismatches, CAST(floor(100 - least(100.0, mismatches * 100.0::DOUBLE / n_rows * 3) + 0.5) AS BIGINT) AS integrity
       FROM (SELECT statement_id, count(*) AS n_rows, count(*) FILTER (WHERE abs(difference) > 1) AS mismatches FROM rec GROUP BY statement_id)""",
    views=(_RECONCILED,),
)
add(
    "running_balance_audit",
    balance.audit,
    """SELECT *, CASE WHEN checked = 0 THEN 1.0::DOUBLE ELSE matched::DOUBLE / checked END AS match_ratio,
       CASE WHEN checked = 0 THEN true ELSE matched::DOUBLE / checked >= 0.95 AND major::DOUBLE / checked <= 0.05 END AS is_reconciled
       FROM (SELECT statement_id, count(*) AS total_rows, count(difference) AS checked, count(*) FILTER (WHERE difference = 0) AS matched,
             count(*) FILTER (WHERE abs(difference) BETWEEN 1 AND 5) AS minor, count(*) FILTER (WHERE abs(difference) > 5) AS major
             FROM rec GROUP BY statement_id)""",
    views=(_RECONCILED,),
)
add(
    "liquidity",
    balance.liquidity,
    """SELECT statement_id, min(balance) AS min_balance, max(balance) AS max_balance, CAST(floor(sum(balance)::DOUBLE / count(*) + 0.5) AS BIGINT) AS avg_balance,
       arg_min(date, ROW(balance, row_idx)) AS max_dip_date, count(*) FILTER (WHERE balance <= 0) AS zero_days FROM ledger GROUP BY statement_id""",
)
add(
    "detect_duplicates",
    lambda df: analytics.duplicates(df).where("is_duplicate").select("statement_id", "row_idx", "date", "ref_number", "duplicate_group"),
    "SELECT statement_id, row_idx, date, ref_number, first_row AS duplicate_group FROM dup WHERE is_duplicate",
    views=(_DUPLICATES,),
)
add(
    "duplicate_count",
    lambda df: analytics.duplicates(df).where("is_duplicate").groupBy("statement_id").agg((F.count(F.lit(1)) - F.countDistinct("duplicate_group")).alias("repeats")),
    "SELECT statement_id, count(*) - count(DISTINCT first_row) AS repeats FROM dup WHERE is_duplicate GROUP BY statement_id",
    views=(_DUPLICATES,),
)
add(
    "ledger_totals",
    analytics.totals,
    """SELECT statement_id, CAST(sum(credit) AS BIGINT) AS credits, CAST(sum(debit) AS BIGINT) AS debits,
       CAST(sum(credit) - sum(debit) AS BIGINT) AS net, count(*) AS n_rows FROM ledger GROUP BY statement_id""",
)
add(
    "category_breakdown",
    analytics.category_breakdown,
    f"""SELECT statement_id, category, n_rows, total_debit, total_credit,
       CASE WHEN spent > 0 THEN total_debit::DOUBLE / spent ELSE 0.0::DOUBLE END AS debit_share FROM (
       SELECT *, sum(total_debit) OVER (PARTITION BY statement_id) AS spent FROM (
       SELECT statement_id, {_CATEGORY} AS category, count(*) AS n_rows, CAST(sum(debit) AS BIGINT) AS total_debit, CAST(sum(credit) AS BIGINT) AS total_credit
       FROM ledger GROUP BY ALL))""",
)
add(
    "monthly_cashflow",
    analytics.monthly_cashflow,
    """SELECT statement_id, month, CAST(sum(credits) AS BIGINT) AS credits, CAST(sum(debits) AS BIGINT) AS debits,
       coalesce(arg_max(balance, date) FILTER (WHERE balance <> 0 AND date > coalesce(latest, '')), 0) AS closing, CAST(sum(credits) - sum(debits) AS BIGINT) AS net
       FROM (SELECT *, max(date) OVER (PARTITION BY statement_id, month ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM (
         SELECT statement_id, substr(date, 1, 7) AS month, date, sum(credit) AS credits, sum(debit) AS debits, min(row_idx) AS first, arg_min(balance, row_idx) AS balance
         FROM ledger GROUP BY ALL)) GROUP BY ALL""",
    kind="orders",
)
add(
    "high_risk_rows",
    lambda df: analytics.high_risk(df).select("statement_id", "row_idx", "description", "risk_type", "risk_flag"),
    " UNION ALL ".join(f"SELECT statement_id, row_idx, description, '{name}' AS risk_type, {_FLAG} AS risk_flag FROM ledger WHERE {test}" for name, test in _RISKS.items()),
)
LOOPS = f"""tra AS (SELECT * FROM (SELECT statement_id, row_idx, {_CATEGORY} AS category,
  substr(regexp_extract(lower(description), '{alerts.COUNTERPARTY}', 1), 1, 24) AS counterparty FROM ledger)
  WHERE category IN ('Transfer In', 'Transfer Out') AND counterparty <> ''),
loops AS (SELECT statement_id, row_idx, counterparty FROM (SELECT *, count(*) OVER k AS n, count(*) FILTER (WHERE category = 'Transfer In') OVER k AS n_in FROM tra
  WINDOW k AS (PARTITION BY statement_id, counterparty)) WHERE n >= 5 AND n_in > 0 AND n_in < n)"""
add(
    "risk_counts",
    lambda df: analytics.high_risk(df)
    .select("statement_id", "risk_type")
    .unionByName(alerts.circular(df).select("statement_id", F.lit("circularTrading").alias("risk_type")))
    .groupBy("statement_id", "risk_type")
    .agg(F.count(F.lit(1)).alias("n_rows")),
    "SELECT statement_id, 'circularTrading' AS risk_type, count(*) AS n_rows FROM loops GROUP BY statement_id UNION ALL " + " UNION ALL ".join(f"SELECT statement_id, '{name}' AS risk_type, count(*) AS n_rows FROM ledger WHERE {test} GROUP BY statement_id" for name, test in _RISKS.items()),
    views=(LOOPS,),
)


def _scored(df: DataFrame) -> DataFrame:
    """Circular rows are flagged last, whatever keywords they have."""
    marked = alerts.flag_circular(analytics.duplicates(balance.reconcile(df)), df)
    marked = marked.withColumn("risk_flag", F.when(F.col("is_circular"), "circularTrading").otherwise(F.try_element_at(risk_types(F.col("description")), F.lit(-1))))
    return analytics.confidence(marked)


_SCORED = f"""conf AS (SELECT r.*, list_filter([
    CASE WHEN trim(r.date) IN ('', 'Unknown') THEN 'missing_date' END,
    CASE WHEN trim(r.description) = '' OR r.description = 'Unknown Transaction' THEN 'missing_description' END,
    CASE WHEN r.debit > 0 AND r.credit > 0 THEN 'both_debit_and_credit' END,
    CASE WHEN r.debit = 0 AND r.credit = 0 THEN 'missing_amount' END,
    CASE WHEN r.balance IS NULL THEN 'missing_balance' END,
    CASE WHEN r.debit < 0 OR r.credit < 0 THEN 'negative_amount' END,
    CASE WHEN abs(r.difference) > 1 THEN 'balance_mismatch' END,
    CASE WHEN d.is_duplicate THEN 'duplicate' END,
    CASE WHEN l.counterparty IS NOT NULL OR {' OR '.join(t.replace('description', 'r.description') for t in _RISKS.values())} THEN 'risk_flag' END], lambda x : x IS NOT NULL) AS reasons
  FROM rec r JOIN dup d USING (statement_id, row_idx) LEFT JOIN loops l USING (statement_id, row_idx)),
points AS (SELECT *, greatest(0, 100 - coalesce(list_sum(list_transform(reasons, lambda x : CASE x WHEN 'missing_date' THEN 30 WHEN 'missing_description' THEN 20
  WHEN 'both_debit_and_credit' THEN 25 WHEN 'missing_amount' THEN 25 WHEN 'missing_balance' THEN 30 WHEN 'negative_amount' THEN 20
  WHEN 'balance_mismatch' THEN 25 ELSE 5 END)), 0)) AS score FROM conf)"""
add(
    "row_confidence",
    lambda df: _scored(df).select("statement_id", "row_idx", "confidence_score", "confidence_reasons"),
    "SELECT statement_id, row_idx, CAST(score AS INTEGER) AS confidence_score, array_to_string(reasons, ',') AS confidence_reasons FROM points",
    views=(_RECONCILED, _DUPLICATES, LOOPS, _SCORED),
)
add(
    "confidence_summary",
    lambda df: analytics.confidence_summary(_scored(df)),
    """SELECT statement_id, CAST(floor(avg(score) + 0.5) AS BIGINT) AS average_score, count(*) FILTER (WHERE score < 70) AS low_confidence, count(*) AS total
       FROM points GROUP BY statement_id""",
    views=(_RECONCILED, _DUPLICATES, LOOPS, _SCORED),
)
