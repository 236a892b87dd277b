"""Circular transfers, fraud alerts and the integrity score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.rules import category, risk_types

from .balance import reconcile

# Fixed value: the counterparty follows one of these words.
COUNTERPARTY = r"(?:to|from|upi|imps|neft|rtgs)\s*[:-]?\s*([a-z0-9@_.-]+)"
TYPES = ["gambling", "paydayLoan", "bouncedPayment", "circularTrading"]


def _named(ledger: DataFrame) -> DataFrame:
    """Ledger rows with _kind (their category) and _name, the counterparty of a transfer or null."""
    name = F.substring(F.regexp_extract(F.lower(F.coalesce("description", F.lit(""))), COUNTERPARTY, 1), 1, 24)
    rows = ledger.withColumn("_kind", category(F.col("description")))
    return rows.withColumn("_name", F.when(F.col("_kind").isin("Transfer In", "Transfer Out"), F.nullif(name, F.lit(""))))


def _both_ways(named: DataFrame, least: int) -> DataFrame:
    """Counterparties with transfers in both directions, ``least`` of them at least: n_in, n_out, total_amount."""
    amount = F.abs(F.when(F.coalesce("debit", F.lit(0)) != 0, F.col("debit")).otherwise(F.coalesce("credit", F.lit(0))))
    found = named.groupBy("statement_id", "_name").agg(
        F.count_if(F.col("_kind") == "Transfer In").alias("n_in"), F.count_if(F.col("_kind") == "Transfer Out").alias("n_out"), F.sum(amount).alias("total_amount"), F.max("_name").alias("_some")
    )
    # rows without a counterparty leave here: a condition on the key would be pushed down, and its patterns matched twice
    return found.where((F.col("n_in") + F.col("n_out") >= least) & (F.col("n_in") > 0) & (F.col("n_out") > 0) & F.col("_some").isNotNull()).drop("_some")


def circular(ledger: DataFrame, least: int = 5) -> DataFrame:
    """The transfer rows of counterparties with at least ``least`` transfers in both directions: statement_id, row_idx, counterparty."""
    named = _named(ledger)
    return named.join(_both_ways(named, least).select("statement_id", "_name"), ["statement_id", "_name"]).select("statement_id", "row_idx", F.col("_name").alias("counterparty"))


def circular_groups(ledger: DataFrame) -> DataFrame:
    """Per circular counterparty of a statement: n_in, n_out, and the sum of the amounts (debit, or credit where it is zero)."""
    return _both_ways(_named(ledger), 5).select("statement_id", F.col("_name").alias("counterparty"), "n_in", "n_out", "total_amount")


def flag_circular(ledger: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Ledger rows with is_circular: whether circular() has the row.

    Counterparties are counted over source, the same rows before other operators worked on them, so that these aren't run twice.
    """
    loops = _both_ways(_named(ledger if source is None else source), 5).select("statement_id", "_name", F.lit(True).alias("is_circular"))
    return _named(ledger).join(loops, ["statement_id", "_name"], "left").drop("_kind", "_name").fillna(False, ["is_circular"])


def findings(ledger: DataFrame, least: int = 5) -> DataFrame:
    """Per statement: n_rows, mismatches, zero_rows (balance at or below zero) and the rows of each risk type.

    Rows are read once: first counted by statement and transfer counterparty, then by statement.
    """
    kind = F.col("kind")
    name = F.when(kind.isin("Transfer In", "Transfer Out"), F.nullif(F.substring(F.regexp_extract(F.lower(F.coalesce("description", F.lit(""))), COUNTERPARTY, 1), 1, 24), F.lit("")))
    types = risk_types(F.col("description"))
    counted = (
        reconcile(ledger)
        .withColumn("kind", category(F.col("description")))
        .groupBy("statement_id", name.alias("counterparty"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(kind == "Transfer In").alias("n_in"),
            F.count_if("balance_mismatch").alias("mismatches"),
            F.count_if(F.coalesce("balance", F.lit(0)) <= 0).alias("zero_rows"),
            *[F.count_if(F.array_contains(types, t)).alias(t) for t in TYPES[:3]],
        )
    )
    loop = F.col("counterparty").isNotNull() & (F.col("n") >= least) & (F.col("n_in") > 0) & (F.col("n_in") < F.col("n"))
    return counted.groupBy("statement_id").agg(
        F.sum("n").alias("n_rows"), *[F.sum(c).alias(c) for c in ("mismatches", "zero_rows", *TYPES[:3])], F.sum(F.when(loop, F.col("n")).otherwise(0)).alias("circularTrading")
    )


# The shares and counts at which an alert becomes more severe.
def fraud_alerts(found: DataFrame) -> DataFrame:
    """One row for each alert of a statement: alert_type, severity and the number of rows it rests on."""
    share = F.col("mismatches") * 100.0 / F.col("n_rows")
    alerts = [
        ("BALANCE_INTEGRITY", "mismatches", F.when(share > 20, "critical").when(share > 10, "high").when(share > 5, "medium").otherwise("low")),
        ("GAMBLING", "gambling", F.when(F.col("gambling") > 3, "high").otherwise("medium")),
        ("PAYDAYLOAN", "paydayLoan", F.lit("high")),
        ("BOUNCEDPAYMENT", "bouncedPayment", F.when(F.col("bouncedPayment") > 2, "critical").otherwise("high")),
        ("CIRCULARTRADING", "circularTrading", F.when(F.col("circularTrading") > 8, "critical").otherwise("high")),
        ("LIQUIDITY_CRISIS", "zero_rows", F.when(F.col("zero_rows") > 3, "critical").otherwise("high")),
    ]
    rows = F.array(*[F.struct(F.lit(t).alias("alert_type"), severity.alias("severity"), F.col(n).alias("affected")) for t, n, severity in alerts])
    return found.select("statement_id", F.inline(rows)).where("affected > 0")


def integrity_score(found: DataFrame) -> DataFrame:
    """100 less 3 a mismatch (at most 35), 5 a risk type that occurs (at most 25) and 5 a zero row (at most 20)."""
    kinds = sum((F.when(F.col(t) > 0, 1).otherwise(0) for t in TYPES), F.lit(0))
    score = 100 - F.least(F.lit(35), F.col("mismatches") * 3) - F.least(F.lit(25), kinds * 5) - F.least(F.lit(20), F.col("zero_rows") * 5)
    return found.select("statement_id", F.greatest(F.lit(0), score).cast("int").alias("integrity_score"))
