"""Statistics of a statement's amounts and balances. Amounts are in minor units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.dates import statement_day
from ledgerlark.functions.rules import category

from .adjacent import following, previous, renumber

# Least threshold of a low balance (minor units) and its share of the median; words of cash withdrawals.
LOW_BALANCE, LOW_SHARE = 100_000, 0.12
CASH = ["atm", "cash withdrawal", "cash wdl", "cash withdraw", "cash wd", "cardless cash", "self cash"]
# Yearly rate and months of the loan that an instalment is taken to repay.
RATE, MONTHS = 0.11, 60


def amount_statistics(ledger: DataFrame, name: str = "credit") -> DataFrame:
    """Per statement, over its positive amounts: n, median, population deviation and coefficient of variation, robust mean.

    Deviation and coefficient are 0 for one amount; the robust mean of five or more leaves one least and one largest out.
    Equal amounts are counted first, so a statement of any length comes together as its distinct amounts.
    """
    x, n = F.col("x").cast("double"), F.col("n")
    counted = ledger.where(F.col(name) > 0).groupBy("statement_id", F.col(name).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    sums = counted.groupBy("statement_id").agg(
        F.sum("n").alias("n_amounts"),
        F.expr("percentile(x, 0.5, n)").alias("median"),
        F.sum(F.col("x") * n).alias("total"),
        F.sum(x * x * n).alias("squares"),
        F.min("x").alias("low"),
        F.max("x").alias("high"),
    )
    mean = F.col("total") / F.col("n_amounts")
    deviation = F.when(F.col("n_amounts") <= 1, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n_amounts") - mean * mean)))
    robust = F.when(F.col("n_amounts") >= 5, (F.col("total") - F.col("low") - F.col("high")) / (F.col("n_amounts") - 2)).otherwise(mean)
    return sums.select("statement_id", "n_amounts", "median", F.round(deviation, 2).alias("deviation"), F.round(deviation / mean, 6).alias("variation"), F.round(robust, 4).alias("robust_mean"))


def low_balance_frequency(ledger: DataFrame) -> DataFrame:
    """Per statement: the low-balance threshold and the share of balances at or below it (0 without balances)."""
    counted = ledger.where(F.col("balance").isNotNull()).groupBy("statement_id", "balance").agg(F.count(F.lit(1)).alias("n"))
    positive = F.expr("percentile(CASE WHEN balance > 0 THEN balance END, 0.5, n)")
    limits = counted.groupBy("statement_id").agg(positive.alias("median"), F.sum("n").alias("all"))
    limits = limits.withColumn("threshold", F.coalesce(F.greatest(F.lit(float(LOW_BALANCE)), F.col("median") * LOW_SHARE), F.lit(float(LOW_BALANCE))))
    low = counted.join(limits.select("statement_id", "threshold"), "statement_id").where(F.col("balance") <= F.col("threshold"))
    found = low.groupBy("statement_id").agg(F.sum("n").alias("low"))
    share = F.coalesce("low", F.lit(0)) / F.col("all")
    return limits.join(found, "statement_id", "left").select("statement_id", F.round("threshold", 4).alias("threshold"), share.alias("low_share"))


def cash_share(ledger: DataFrame) -> DataFrame:
    """Per statement: the share of its debits that are cash withdrawals, by narration or category."""
    text, debit = F.lower(F.coalesce("description", F.lit(""))), F.greatest(F.lit(0), F.coalesce("debit", F.lit(0)))
    cash = F.when(text.rlike("|".join(CASH)) | (category(F.col("description")) == "Cash"), debit).otherwise(0)
    return ledger.groupBy("statement_id").agg(F.sum(debit).alias("debits"), F.sum(cash).alias("cash")).select(
        "statement_id", F.when(F.col("debits") > 0, F.col("cash") / F.col("debits")).otherwise(0.0).alias("cash_share")
    )


def principal(instalment: Column, rate: float = RATE, months: int = MONTHS) -> Column:
    """The loan that equal monthly instalments repay at a yearly rate; 0 for none."""
    growth = (1 + rate / 12) ** months
    factor = months if rate <= 0 else (growth - 1) / (rate / 12 * growth)
    return F.when(instalment > 0, instalment * F.lit(factor)).otherwise(0.0)


def instalments(ledger: DataFrame) -> DataFrame:
    """The debits of the loan category with the principal that each would repay over the usual term."""
    rows = ledger.where((category(F.col("description")) == "Loan/EMI") & (F.col("debit") > 0))
    return rows.select("statement_id", "row_idx", "debit", F.round(principal(F.col("debit").cast("double")), 2).alias("principal"))


def direction_mismatch(ledger: DataFrame) -> DataFrame:
    """Per statement: the share of neighbouring balances that a row's amounts don't explain, read forward and reversed, and the lesser."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    off = lambda other: F.abs(F.col("balance") - (F.col(other) + zero("credit") - zero("debit")))
    rows = following(previous(ledger, before=F.col("balance")), after=F.col("balance"))
    share = lambda other: F.coalesce(F.try_divide(F.count_if(off(other) > 1), F.count(off(other))), F.lit(0.0))
    found = rows.groupBy("statement_id").agg(share("before").alias("forward"), share("after").alias("reversed"))
    return found.withColumn("mismatch_ratio", F.least("forward", "reversed"))


def date_order(ledger: DataFrame) -> DataFrame:
    """Per statement: steps against the order (the lesser of both directions) and plausible steps (-2 to 45 days, the better direction), as shares.

    Rows whose date can't be read are left out first, and the neighbours that remain are compared. With one readable date
    there is no step: the first share is 0 and the second 1. Without any, both are 0.
    """
    dated = ledger.select("statement_id", "row_idx", statement_day(F.col("date")).alias("day")).where("day is not null")
    step = F.datediff("day", "before")
    most = lambda low, high: F.count_if((step >= low) & (step <= high))
    counted = previous(renumber(dated), before=F.col("day")).groupBy("statement_id").agg(
        F.count(step).alias("n"), F.least(F.count_if(step < 0), F.count_if(step > 0)).alias("against"), F.greatest(most(-2, 45), most(-45, 2)).alias("plausible")
    )
    every = ledger.select("statement_id").distinct().join(counted, "statement_id", "left")
    continuity = F.when(F.col("n").isNull(), 0.0).when(F.col("n") == 0, 1.0).otherwise(F.try_divide("plausible", "n"))
    return every.select("statement_id", F.coalesce(F.try_divide("against", "n"), F.lit(0.0)).alias("violation_ratio"), continuity.alias("continuity"))
