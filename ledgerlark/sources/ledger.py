"""Ledgers derived from the event and order tables, so that operators have statement rows to work on.

Columns: statement_id, row_idx (from 0, statement order), date (ISO text), description, ref_number, debit, credit, balance
(minor units). Everything follows from ids, so the same rows can be written in SQL. About one balance in twelve is off, by
amounts of every size class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import plain_unions

# Fixed values of the synthetic narrations, by id.
NARRATIONS = [
    "NEFT CR SALARY ACME LTD", "UPI DR paid to alice@bank", "UPI CR received from alice@bank", "ELECTRICITY BILL", "AMAZON RETAIL",
    "SWIGGY FOOD ORDER", "UBER TRIP", "NETFLIX.COM", "APOLLO PHARMACY", "UDEMY COURSE", "INSURANCE PREMIUM", "ZERODHA TRADING",
    "HOME LOAN EMI", "ATM WDL", "SERVICE CHARGE", "BET365 STAKE", "QUICKLOAN PAYDAY", "ECS RETURN INSUFFICIENT FUNDS", "MISC", "",
    "IMPS-bob transfer out", "IMPS-bob transfer in", "CASINO BOUNCE", "Unknown Transaction",
]

_TEXT = "CASE id % {n} {cases} END".format(n=len(NARRATIONS), cases=" ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(NARRATIONS)))
_REF = "CASE WHEN id % 7 = 0 THEN '' WHEN id % 11 = 0 THEN 'DUP' ELSE concat('R', id) END"
_BUMP = (
    "CASE WHEN id % 103 = 0 THEN 1500000 WHEN id % 101 = 0 THEN 150000 WHEN id % 97 = 0 THEN 15000 WHEN id % 89 = 0 THEN 3 "
    "WHEN id % 83 = 0 THEN 1 ELSE 0 END"
)
_LEDGER = """
SELECT statement_id, CAST(row_number() OVER (PARTITION BY statement_id ORDER BY seen_at, id) - 1 AS BIGINT) AS row_idx, substr(CAST(seen_at AS {text}), 1, 10) AS date, {narration} AS description,
  {ref} AS ref_number, debit, credit,
  CAST(100000 + sum(credit - debit) OVER (PARTITION BY statement_id ORDER BY seen_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + {bump} AS BIGINT) AS balance
FROM (SELECT *, CASE WHEN id % 3 = 0 THEN 0 ELSE amount END AS debit, CASE WHEN id % 3 = 0 THEN amount * 2 ELSE 0 END AS credit
      FROM (SELECT {id} AS id, {statement} AS statement_id, {at} AS seen_at,
                   CASE WHEN {id} % 11 = 0 THEN 5000 WHEN {id} % 37 = 0 THEN 0 ELSE CAST(floor({value} * 100 + 0.5) AS BIGINT) END AS amount
            FROM {table}) a) b
"""


def ledger_sql(kind: str, text: str = "string") -> str:
    """SQL of the ledger of ``events`` (one month, by user) or ``orders`` (years, fifty statements)."""
    own = {
        "events": {"id": "event_id", "statement": "user_id", "at": "ts", "value": "value", "table": "events"},
        "orders": {"id": "o_orderkey", "statement": "o_custkey % 50", "at": "o_orderdate", "value": "o_totalprice", "table": "orders"},
    }[kind]
    return _LEDGER.format(narration=_TEXT, ref=_REF, bump=_BUMP, text=text, **own)


def ledger(spark: SparkSession, sf_dir: str, kind: str = "events") -> DataFrame:
    plain_unions(spark)
    return spark.sql(ledger_sql(kind).replace(f"FROM {kind}", "FROM {source}"), source=spark.read.parquet(f"{sf_dir}/{kind}.parquet"))
