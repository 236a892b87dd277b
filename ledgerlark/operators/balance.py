"""Running-balance operators. They look at adjacent rows of a statement in row_idx order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.money import half_up

from .adjacent import previous


def reconcile(ledger: DataFrame) -> DataFrame:
    """Ledger rows with expected_balance, difference, balance_mismatch and severity. Missing amounts count as zero."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    expected = F.col("_before") + zero("credit") - zero("debit")
    size = F.abs(F.col("difference"))
    return (
        previous(ledger, _before=zero("balance"))
        .withColumn("expected_balance", expected)
        .drop("_before")
        .withColumn("difference", zero("balance") - F.col("expected_balance"))
        .withColumn("balance_mismatch", F.coalesce(size > 1, F.lit(False)))
        .withColumn(
            "severity",
            F.when(F.col("balance_mismatch"), F.when(size > 1_000_000, "critical").when(size > 100_000, "high").when(size > 10_000, "medium").otherwise("low")),
        )
    )


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    """Per statement: rows, mismatches and the integrity percentage."""
    share = F.col("mismatches") * 100.0 / F.col("n_rows")
    return (
        reconciled.groupBy("statement_id")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("balance_mismatch").alias("mismatches"))
        .withColumn("integrity", half_up(100 - F.least(F.lit(100.0), share * 3)).cast("long"))
    )


def audit(ledger: DataFrame, minor: int = 5) -> DataFrame:
    """Per statement: pairs of rows with both balances, by exact, minor (at most ``minor`` units) and major difference."""
    off = F.abs(F.col("_before") + F.coalesce("credit", F.lit(0)) - F.coalesce("debit", F.lit(0)) - F.col("balance"))
    counted = (
        previous(ledger, _before=F.col("balance"))
        .withColumn("off", off)
        .groupBy("statement_id")
        .agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count("off").alias("checked"),
            F.count_if(F.col("off") == 0).alias("matched"),
            F.count_if((F.col("off") > 0) & (F.col("off") <= minor)).alias("minor"),
            F.count_if(F.col("off") > minor).alias("major"),
        )
    )
    ratio = lambda c, empty: F.when(F.col("checked") == 0, empty).otherwise(F.col(c) / F.col("checked"))
    return counted.withColumn("match_ratio", ratio("matched", 1.0)).withColumn(
        "is_reconciled", (F.col("match_ratio") >= 0.95) & (ratio("major", 0.0) <= 0.05)
    )


def liquidity(ledger: DataFrame) -> DataFrame:
    """Per statement: least, largest and mean balance (rounded to a minor unit), the date of the first least one, and rows at or below zero."""
    b = F.coalesce(F.col("balance"), F.lit(0))
    return ledger.groupBy("statement_id").agg(
        F.min(b).alias("min_balance"),
        F.max(b).alias("max_balance"),
        half_up(F.sum(b) / F.count(F.lit(1))).cast("long").alias("avg_balance"),
        F.min_by("date", F.struct(b, F.col("row_idx"))).alias("max_dip_date"),
        F.count_if(b <= 0).alias("zero_days"),
    )
