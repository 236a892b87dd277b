"""Plausibility of running balances, and statement summaries. Amounts are in minor units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .adjacent import previous


def _amount(name: str):
    return F.abs(F.coalesce(F.col(name), F.lit(0)))


def balance_flow(ledger: DataFrame) -> DataFrame:
    """Per statement: pairs of rows with both balances (checked), those that fit within the tolerance, and the mismatch ratio.

    The tolerance is 0.15 % of the largest amount or balance of the pair, at least 5 and at most 300 units. The ratio is 0
    for a single row and 1 if no pair can be checked.
    """
    debit, credit, before, now = _amount("debit"), _amount("credit"), F.col("before"), F.col("balance")
    tolerance = F.greatest(F.lit(5.0), F.least(F.lit(300.0), F.greatest(debit, credit, F.abs(before), F.abs(now)) * 0.0015))
    off = F.abs(before + credit - debit - now)
    counted = (
        previous(ledger, before=F.col("balance"))
        .groupBy("statement_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count(off).alias("checked"), F.count_if(off <= tolerance).alias("matched"))
    )
    ratio = F.when(F.col("n_rows") <= 1, 0.0).when(F.col("checked") == 0, 1.0).otherwise((F.col("checked") - F.col("matched")) / F.col("checked"))
    return counted.withColumn("mismatch_ratio", ratio)


def delta_anomalies(ledger: DataFrame) -> DataFrame:
    """Per statement: balance steps of 1000 units or more, those that the row's amount doesn't explain, and their share."""
    delta = F.abs(F.col("balance") - F.col("before"))
    amount = F.greatest(_amount("debit"), _amount("credit"))
    off = F.abs(delta - amount)
    unexplained = (off > F.greatest(F.lit(100.0), delta * 0.02)) & ((amount < delta * 0.6) | (off > delta * 0.2))
    counted = (
        previous(ledger, before=F.col("balance"))
        .groupBy("statement_id")
        .agg(F.count_if(delta >= 1000).alias("checks"), F.count_if((delta >= 1000) & ((amount <= 0) | unexplained)).alias("anomalies"))
    )
    return counted.withColumn("rate", F.when(F.col("checks") > 0, F.col("anomalies") / F.col("checks")).otherwise(0.0))


def statement_summary(ledger: DataFrame) -> DataFrame:
    """Per statement: opening and closing balance, credits, debits, net, rows and distinct days."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    days = ledger.groupBy("statement_id", "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(zero("credit")).alias("c"),
        F.sum(zero("debit")).alias("d"),
        F.min(F.struct("row_idx", (zero("balance") - zero("credit") + zero("debit")).alias("v"))).alias("first"),
        F.max(F.struct("row_idx", zero("balance").alias("v"))).alias("last"),
    )  # first by day, so that distinct days need no further shuffle of all rows
    return days.groupBy("statement_id").agg(
        F.min("first")["v"].alias("opening"),
        F.max("last")["v"].alias("closing"),
        F.sum("c").alias("credits"),
        F.sum("d").alias("debits"),
        (F.sum("c") - F.sum("d")).alias("net"),
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_days"),
    )
