"""Duplicates, totals, breakdowns, risk and confidence of statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.money import clamp, half_up
from ledgerlark.functions.rules import category, risk_types


def duplicates(ledger: DataFrame) -> DataFrame:
    """is_duplicate and duplicate_group (1-based index of the first member) for rows that share date, reference and amount.

    Rows without a reference are never duplicates and are not compared.
    """
    amount = F.when(F.col("debit") > 0, F.col("debit")).otherwise(F.col("credit"))
    none = F.when(F.coalesce("ref_number", F.lit("")) == "", F.col("row_idx"))  # a group of its own for each such row
    key = Window.partitionBy("statement_id", "date", "ref_number", "_amount", "_none")
    found = ledger.withColumns({"_amount": amount, "_none": none}).withColumns({"_n": F.count(F.lit(1)).over(key), "_first": F.min("row_idx").over(key) + 1})
    is_duplicate = (F.col("_n") > 1) & F.col("_none").isNull()
    return found.withColumn("is_duplicate", is_duplicate).withColumn("duplicate_group", F.when(is_duplicate, F.col("_first"))).drop("_amount", "_none", "_n", "_first")


def totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("statement_id").agg(
        F.sum("credit").alias("credits"), F.sum("debit").alias("debits"), (F.sum("credit") - F.sum("debit")).alias("net"), F.count(F.lit(1)).alias("n_rows")
    )


def category_breakdown(ledger: DataFrame) -> DataFrame:
    """Per statement and category: rows, debit, credit, and the share of the statement's debit."""
    by = ledger.withColumn("category", category(F.col("description"))).groupBy("statement_id", "category").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("debit").alias("total_debit"), F.sum("credit").alias("total_credit")
    )  # at most 16 rows for a statement
    spent = F.sum("total_debit").over(Window.partitionBy("statement_id"))
    return by.withColumn("debit_share", F.when(spent > 0, F.col("total_debit") / spent).otherwise(0.0))


def monthly_cashflow(ledger: DataFrame) -> DataFrame:
    """Per statement and month: credits, debits, net, and closing.

    Closing is the balance of the first row of the month's last date. A zero or absent balance keeps that of the latest date
    before it, 0 if there is none; a date that begins after a later one doesn't count.
    """
    month = F.substring("date", 1, 7).alias("month")
    days = ledger.groupBy("statement_id", month, "date").agg(
        F.sum("credit").alias("credits"), F.sum("debit").alias("debits"), F.min("row_idx").alias("first"), F.min_by("balance", "row_idx").alias("balance")
    )
    before = Window.partitionBy("statement_id", "month").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    counts = (F.col("date") > F.coalesce(F.max("date").over(before), F.lit(""))) & (F.col("balance") != 0)
    return (
        days.withColumn("closing", F.when(counts, F.col("balance")))
        .groupBy("statement_id", "month")
        .agg(
            F.sum("credits").alias("credits"),
            F.sum("debits").alias("debits"),
            F.coalesce(F.max_by("closing", F.when(F.col("closing").isNotNull(), F.col("date"))), F.lit(0).cast("long")).alias("closing"),
        )
        .withColumn("net", F.col("credits") - F.col("debits"))
    )


def high_risk(ledger: DataFrame) -> DataFrame:
    """The rows with a risk keyword, once for each type; risk_flag is the last type of the row."""
    found = ledger.withColumn("types", risk_types(F.col("description"))).where(F.size("types") > 0)
    return found.withColumn("risk_flag", F.element_at("types", -1)).withColumn("risk_type", F.explode("types")).drop("types")


def confidence(ledger: DataFrame) -> DataFrame:
    """confidence_score and confidence_reasons (comma-separated) of every row; takes balance_mismatch, is_duplicate and risk_flag."""
    text, date = F.coalesce("description", F.lit("")), F.trim(F.coalesce("date", F.lit("")))
    debit, credit = F.coalesce("debit", F.lit(0)), F.coalesce("credit", F.lit(0))
    rules = [
        ("missing_date", 30, (date == "") | (date == "Unknown")),
        ("missing_description", 20, (F.trim(text) == "") | (text == "Unknown Transaction")),
        ("both_debit_and_credit", 25, (debit > 0) & (credit > 0)),
        ("missing_amount", 25, (debit == 0) & (credit == 0)),
        ("missing_balance", 30, F.col("balance").isNull()),
        ("negative_amount", 20, (debit < 0) | (credit < 0)),
        ("balance_mismatch", 25, F.coalesce("balance_mismatch", F.lit(False))),
        ("duplicate", 5, F.coalesce("is_duplicate", F.lit(False))),
        ("risk_flag", 5, F.col("risk_flag").isNotNull()),
    ]
    score = F.lit(100)
    for _, points, holds in rules:
        score = score - F.when(holds, points).otherwise(0)
    return ledger.withColumn("confidence_score", clamp(score, 0, 100).cast("int")).withColumn(
        "confidence_reasons", F.concat_ws(",", *[F.when(holds, name) for name, _, holds in rules])
    )


def confidence_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("statement_id").agg(
        half_up(F.avg("confidence_score")).cast("long").alias("average_score"), F.count_if(F.col("confidence_score") < 70).alias("low_confidence"), F.count(F.lit(1)).alias("total")
    )
