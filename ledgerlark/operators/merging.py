"""Several statements of one account as one: eligibility, order, repeats, closing balance and the merged header.

Rows: group_id (what is merged), file_idx (from 0), row_idx (from 0 in each file), and the ledger's columns. Headers: group_id,
file_idx, file_name, bank_name, account_number, currency, account_holder, statement_period, closing_balance (minor units).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.dates import let, merge_day, trimmed

from .adjacent import BLOCK, renumber

# The reasons why statements can't be merged.
ONLY_ONE, MISSING, MISMATCH = "Only one statement uploaded", "Missing {} in ", "{} mismatch in "


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "")


def account_key(text: Column) -> Column:
    return F.regexp_replace(F.upper(trimmed(F.coalesce(text, F.lit("")))), "[^A-Z0-9]+", "")


def currency_key(text: Column) -> Column:
    return F.regexp_replace(F.upper(trimmed(F.coalesce(text, F.lit("")))), "[^A-Z]+", "")


# Header fields that must agree, their names in reasons, and how they are compared.
AGREEING = [("bank_name", "bank name", _letters), ("account_number", "account number", account_key), ("currency", "currency", currency_key)]
DISPLAYED = ["bank_name", "account_number", "currency", "account_holder"]


def _first_filled(name: str) -> Column:
    """The first value in file order that isn't blank, trimmed."""
    value = trimmed(F.col(name))
    return F.min_by(value, F.when(F.coalesce(value != "", F.lit(False)), F.col("file_idx")))


def merge_eligibility(headers: DataFrame) -> DataFrame:
    """group_id, can_merge, reasons (in file order), and the first filled bank_name, account_number, currency, account_holder.

    A group needs two statements or more, and every statement a bank, an account and a currency that agree with the first
    filled ones, letters and digits alone. A header's text of blanks only is not missing, but agrees with nothing.
    """
    shown = headers.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_files"), *[_first_filled(c).alias(f"first_{c}") for c in DISPLAYED])
    reasons = []
    for column, title, key in AGREEING:
        value = F.coalesce(F.col(column), F.lit(""))
        off = key(F.col(column)) != key(F.col(f"first_{column}"))
        reasons.append(F.when(value == "", F.concat(F.lit(MISSING.format(title)), F.col("file_name"))).when(off, F.concat(F.lit(MISMATCH.format(title.capitalize())), F.col("file_name"))))
    judged = headers.join(shown, "group_id").withColumn("_reasons", F.array_compact(F.array(*reasons)))
    listed = judged.groupBy("group_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("file_idx", "_reasons"))), lambda x: x["_reasons"])).alias("_reasons"))  # a row for each file
    found = shown.join(listed, "group_id")
    alone = F.when(F.col("n_files") < 2, F.array(F.lit(ONLY_ONE))).otherwise(F.array().cast("array<string>"))
    found = found.withColumn("reasons", F.concat(alone, "_reasons"))
    return found.select("group_id", (F.size("reasons") == 0).alias("can_merge"), "reasons", *[F.col(f"first_{c}").alias(c) for c in DISPLAYED])


def merge_rows(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of all files of a group in one order: statement_id (the group), row_idx (anew), file_idx, file_row, day, and the other columns.

    Rows stand by merge_day, those without one last, then by file and row. Nothing is left out. They are numbered by days, files and
    blocks of rows, so a file of any length spreads over tasks.
    """
    dated = rows.withColumn("day", merge_day(F.col("date"))).withColumnRenamed("group_id", "statement_id").withColumnRenamed("row_idx", "file_row")
    return renumber(dated, block, by=("day", "file_idx", "file_row"))


def repeats(merged: DataFrame) -> DataFrame:
    """statement_id, duplicates: rows with a reference whose date, reference and amount an earlier row had."""
    amount = F.abs(F.when(F.col("debit") > 0, F.col("debit")).otherwise(F.coalesce("credit", F.lit(0))))
    keys = merged.where("ref_number <> ''").groupBy("statement_id", trimmed(F.coalesce("date", F.lit(""))).alias("date"), "ref_number", amount.alias("amount")).agg((F.count(F.lit(1)) - 1).alias("n"))
    return keys.groupBy("statement_id").agg(F.sum("n").alias("duplicates"))


def period_days(period: Column) -> Column:
    """struct(start, end): two numeric dates in a period's text, else the texts around its first dash; an end that can't be read is null."""
    numeric = F.regexp_extract_all(period, F.lit(r"(\d{1,4}[/-]\d{1,2}[/-]\d{1,4})"), 1)
    ends = F.when(F.size(numeric) >= 2, numeric).otherwise(F.split(period, r"\s*[-–—]\s*"))
    both = let(ends, lambda p: F.when(F.size(p) >= 2, F.struct(F.get(p, 0).alias("a"), F.get(p, 1).alias("b"))))
    return let(both, lambda x: F.struct(merge_day(x["a"]).alias("start"), merge_day(x["b"]).alias("end")))


def final_balances(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """group_id, final_balance: that of the statement that ends last (the later file if two end alike), or null.

    A statement ends with its printed period if that has both ends, else with its last dated row; one without either ends
    before all others. Its closing balance counts, else the balance of its last dated row (the lower one of a day).
    """
    dated = rows.select("group_id", "file_idx", "row_idx", "balance", merge_day(F.col("date")).alias("day")).where("day is not null")
    last = dated.groupBy("group_id", "file_idx").agg(F.max("day").alias("last_day"), F.max_by(F.struct("balance"), F.struct("day", "row_idx")).alias("last_row"))
    period = period_days(F.col("statement_period"))
    ends = headers.withColumn("_p", period).join(last, ["group_id", "file_idx"], "left")
    whole = F.col("_p.start").isNotNull() & F.col("_p.end").isNotNull()
    ends = ends.withColumn("_end", F.when(whole, F.col("_p.end")).otherwise(F.col("last_day")))
    balance = F.coalesce("closing_balance", "last_row.balance")
    at = F.struct(F.col("_end").isNotNull(), "_end", "file_idx")
    return ends.groupBy("group_id").agg(F.max_by(F.struct(balance.alias("b")), at).alias("last")).select("group_id", F.col("last.b").alias("final_balance"))


def merge_summary(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """group_id, n_rows, duplicates, total_debit, total_credit, statement_period (first to last dated row, as written), final_balance, and the first filled header fields."""
    merged = merge_rows(rows)
    label = trimmed(F.col("date"))
    dated = F.when(F.col("day").isNotNull() & (label != ""), F.col("row_idx"))
    sums = merged.groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.sum(F.abs(F.coalesce(c, F.lit(0)))).alias(f"total_{c}") for c in ("debit", "credit")],
        F.concat(F.min_by(label, dated), F.lit(" to "), F.max_by(label, dated)).alias("statement_period"),
    )
    found = sums.join(repeats(merged), "statement_id", "left").withColumnRenamed("statement_id", "group_id")
    shown = headers.groupBy("group_id").agg(*[_first_filled(c).alias(c) for c in DISPLAYED])
    found = shown.join(found, "group_id", "left").join(final_balances(rows, headers), "group_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "duplicates", "total_debit", "total_credit")]
    return found.select("group_id", *counts, "statement_period", "final_balance", *DISPLAYED)
