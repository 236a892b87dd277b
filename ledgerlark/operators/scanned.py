"""Rows read from scanned pages: strict numbers, row clean-up, repair by the balance, and confidence.

Raw rows: statement_id, row_idx, and text columns date, description, ref_number, debit, credit, balance, amount, type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.dates import let, scanned_date, tidy, trimmed
from ledgerlark.functions.money import half_up
from ledgerlark.functions.references import best_reference
from ledgerlark.sources.shared import written

from .adjacent import BLOCK, previous, renumber
from .flow import balance_flow
from .repair import lock_columns, validate_rows

# The forms of a number, letters that scans read for digits, headings that are no narration, and what stands for one.
NUMBER_FORMS = [r"\d{1,3}(?:,\d{3})*(?:\.\d{1,3})?", r"\d{1,3}(?:\.\d{3})*(?:,\d{1,3})?", r"\d{1,3}(?:,\d{2})+(?:,\d{3})?(?:\.\d{1,3})?", r"\d+(?:[.,]\d{1,3})?"]
MISREAD = ("oOlIsSbB", "00115588")
HEADINGS = r"(?i)\b(transaction date|value date|running balance|debit amount|credit amount|description|narration|statement of accounts|account statement|total records|page\s+\d+)\b"
UNREADABLE, LOW = "UNREADABLE", "low_confidence"
# Points (hundredths) that a row loses, the least it keeps, and the score from which it is sure.
NO_TEXT, NO_BALANCE, NO_SIDE, TAGGED, FAR, NEAR, LEAST, SURE = 45, 45, 30, 30, 35, 10, 20, 80
FAR_UNITS, NEAR_UNITS = 100, 20


def strict_number(text: Column) -> Column:
    """Minor units of a scanned number, or null if it has none of the known forms.

    A minus may stand at either end. Letters between digits are read as the digits they look like. The right-most separator is
    the decimal point and may occur once, so 1,234 is 1.23 and 1,234,567 is none.
    """

    # each step by let: a name used twice would be computed twice, and what it is made of as often again
    def value(raw: Column) -> Column:
        front = F.when(~raw.startswith("-") & raw.endswith("-"), F.concat(F.lit("-"), F.substring(raw, F.lit(1), F.length(raw) - 1))).otherwise(raw)
        return let(front, lambda x: let(F.when(x.rlike("[A-Za-z]") & x.rlike("[0-9]"), F.translate(x, *MISREAD)).otherwise(x), kept))

    def kept(fixed: Column) -> Column:
        return let(F.regexp_replace(fixed, "[^0-9,.-]", ""), lambda k: let(F.regexp_replace(k, "^-", ""), lambda plain: parsed(k, plain)))

    def parsed(kept: Column, plain: Column) -> Column:
        known = plain.rlike("^(?:" + "|".join(NUMBER_FORMS) + ")$")
        split = plain.rlike(r"^(?:[0-9,]*\.[0-9]+|[0-9.]*,[0-9]+|[0-9]+)$")
        number = F.regexp_replace(F.regexp_replace(plain, r"[.,](?=.*[.,])", ""), ",", ".").try_cast("double")
        signed = number * F.when(kept.startswith("-"), -1).otherwise(1)
        return F.when(known & split, half_up(signed * 100).cast("long"))

    return let(trimmed(text), value)


def normalize_scanned(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """statement_id, row_idx (anew), raw_row, date, description, ref_number, debit, credit, balance, amount, type, low_confidence.

    Rows without a date of scans, or without any amount and balance, are left out. A blank narration or a heading is UNREADABLE.
    A single amount goes to the side that the type names; if both sides have one, the larger goes there. Rows without a narration or a
    balance are of low confidence.
    """
    text = tidy(F.coalesce("description", F.lit("")))
    readable = (text != "") & ~text.rlike(HEADINGS)
    kind = F.lower(F.coalesce("type", F.lit("")))
    number = {c: F.coalesce(F.abs(strict_number(F.col(c))), F.lit(0)) for c in ("debit", "credit", "amount")}
    known = rows.select(
        "statement_id", "row_idx", scanned_date(F.col("date")).alias("date"), F.when(readable, text).otherwise(UNREADABLE).alias("description"), F.col("ref_number").alias("_ref"),
        *[v.alias(c) for c, v in number.items()], strict_number(F.col("balance")).alias("balance"), F.nullif(F.trim("type"), F.lit("")).alias("type"), readable.alias("_readable"),
        kind.rlike(r"\b(cr|credit)\b").alias("_cr"), kind.rlike(r"\b(dr|debit)\b").alias("_dr"),
    )
    known = written(known, "scanned").where("date is not null")  # else Spark would run the patterns again in the filters, and for each count
    none, both, larger = (F.col("debit") <= 0) & (F.col("credit") <= 0), (F.col("debit") > 0) & (F.col("credit") > 0), F.greatest("debit", "credit")
    cr, dr = F.col("_cr"), ~F.col("_cr") & F.col("_dr")
    debit = F.when(none & dr, F.col("amount")).when(both & cr, 0).when(both & dr, larger).otherwise(F.col("debit"))
    credit = F.when(none & cr, F.col("amount")).when(both & cr, larger).when(both & dr, 0).otherwise(F.col("credit"))
    known = known.where(~none | F.col("balance").isNotNull() | (F.col("amount") > 0)).withColumns({"debit": debit, "credit": credit})
    known = known.withColumns({"ref_number": best_reference(F.col("_ref"), F.col("description")), "low_confidence": ~F.col("_readable") | F.col("balance").isNull(), "raw_row": F.col("row_idx")})
    out = ["statement_id", "row_idx", "raw_row", "date", "description", "ref_number", "debit", "credit", "balance", "amount", "type", "low_confidence"]
    return renumber(known.select(*out), block)


def with_confidence(rows: DataFrame) -> DataFrame:
    """rows (description, debit, credit, balance, low_confidence) with confidence, in hundredths from 20 to 100.

    Points go for a missing narration, for a missing balance where the statement has any, for no amount or two, for a tag, and for a
    balance that doesn't follow from the row before.
    """
    has = rows.groupBy("statement_id").agg((F.count("balance") > 0).alias("_has"))
    debit, credit = (F.abs(F.coalesce(c, F.lit(0))) for c in ("debit", "credit"))
    off = F.abs(F.col("_before") + credit - debit - F.col("balance"))
    text = F.trim(F.coalesce("description", F.lit("")))
    lost = lambda n, test: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    score = 100 - lost(NO_TEXT, text.isin("", UNREADABLE)) - lost(NO_BALANCE, F.col("_has") & F.col("balance").isNull()) - lost(NO_SIDE, (debit > 0) == (credit > 0)) - lost(TAGGED, F.col("low_confidence"))
    score = score - F.when(off > FAR_UNITS, FAR).when(off > NEAR_UNITS, NEAR).otherwise(0)
    return previous(rows, _before=F.col("balance")).join(has, "statement_id").withColumn("confidence", F.greatest(F.lit(LEAST), score)).drop("_before", "_has")


def scanned_rows(rows: DataFrame) -> DataFrame:
    """Raw rows through normalize_scanned, lock_columns and validate_rows, with balance_inferred, low_confidence and confidence.

    What the patterns read and what the balances repair is written once each: later steps look at a row and its neighbours again.
    """
    known = written(normalize_scanned(rows).withColumnRenamed("low_confidence", "_low"), "numbered")
    checked = validate_rows(lock_columns(known)).withColumn("low_confidence", F.col("low_confidence") | F.col("_low")).drop("_low")
    return with_confidence(written(checked, "validated"))


def scan_summary(rows: DataFrame) -> DataFrame:
    """Per statement: n_rows, avg_confidence (to two decimals), issues, quality (confidence less what balances don't follow, more for many rows)."""
    sums = rows.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("confidence").alias("mean"), F.count_if(F.col("confidence") < SURE).alias("low"), F.count_if(F.col("description") == UNREADABLE).alias("unread"))
    flow = balance_flow(rows).select("statement_id", "mismatch_ratio")
    two = lambda x: half_up(x * 100) / 100
    issues = F.array_compact(F.array(F.when(F.col("low") > 0, F.format_string("low_confidence_rows:%d", "low")), F.when(F.col("unread") > 0, F.format_string("unreadable_rows:%d", "unread"))))
    quality = F.col("mean") / 100 - F.col("mismatch_ratio") * 0.7 + F.least(F.lit(0.1), F.col("n_rows") / 500)
    return sums.join(flow, "statement_id", "left").select("statement_id", "n_rows", two(F.col("mean") / 100).alias("avg_confidence"), issues.alias("issues"), two(quality).alias("quality"))
