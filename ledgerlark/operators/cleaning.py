"""Row clean-up: signs, narration noise, and the filters that decide which rows are transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of rows that are no transactions when they carry no amount.
NOT_A_TRANSACTION = [
    "opening balance", "closing balance", "balance brought forward", "balance b/f", "balance carried forward", "beginning balance",
    "ending balance", "statement total", "total", "summary", "page", "subtotal", "grand total",
]
# Misread words and their repairs, in order.
REPAIRS = [("OWW", "O/W"), ("MARRIOITT", "MARRIOTT"), ("HIJTON", "HILTON"), ("THEBANC", "THEBANQ")]
# Forms of a date.
DATE_FORMS = [r"^\d{4}-\d{2}-\d{2}$", r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}", r"(?i)\b(jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)\b"]
# Parts of a narration that name no counterparty, and how much of the rest counts.
RAILS, KEY_LENGTH = "utr|ref|txn|id|no|trf|transfer|imps|neft|rtgs|upi", 72


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_signs(ledger: DataFrame) -> DataFrame:
    """Negative amounts on the wrong side move to the other; else both lose their sign. Missing amounts are zero."""
    debit, credit = _zero("debit"), _zero("credit")
    to_credit, to_debit = (debit < 0) & (credit <= 0), (credit < 0) & (debit <= 0)
    return ledger.withColumns(
        {
            "debit": F.when(to_credit, 0).when(to_debit, F.abs(credit)).otherwise(F.abs(debit)).cast("long"),
            "credit": F.when(to_credit, F.abs(debit)).when(to_debit, 0).otherwise(F.abs(credit)).cast("long"),
        }
    )


def repair_text(description: Column) -> Column:
    """White space made single, misread words repaired; null is empty."""
    text = _spaced(F.coalesce(description, F.lit("")))
    for wrong, right in REPAIRS:
        text = F.regexp_replace(text, rf"(?i)\b{wrong}\b", right)
    return _spaced(text)


def date_like(date: Column) -> Column:
    text, found = F.trim(F.coalesce(date, F.lit(""))), F.lit(False)
    for form in DATE_FORMS:
        found = found | text.rlike(form)
    return found


def transactions_only(ledger: DataFrame) -> DataFrame:
    """Rows with a date that are neither headers nor totals and have an amount on one side."""
    text = F.lower(F.trim(F.coalesce("description", F.lit(""))))
    header = F.array_contains(F.transform(F.array(*map(F.lit, NOT_A_TRANSACTION)), lambda w: F.contains(text, w)), True)
    amount = (_zero("debit") != 0) | (_zero("credit") != 0)
    return ledger.where(date_like(F.col("date")) & amount & ~(header & ~amount))


def accepted(ledger: DataFrame) -> DataFrame:
    """Rows with a date other than Unknown, a description and any amount or balance."""
    date, text = F.trim(F.coalesce("date", F.lit(""))), F.trim(F.coalesce("description", F.lit("")))
    return ledger.where((date != "") & (F.col("date") != "Unknown") & (text != "") & F.coalesce("debit", "credit", "balance").isNotNull())


def narration_key(description: Column) -> Column:
    """What is left of a narration without words that hold digits, rails and punctuation."""
    text = F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), r"[a-z]*\d+[a-z\d]*", " ")
    text = F.regexp_replace(F.regexp_replace(text, rf"\b(?:{RAILS})\b", " "), r"[^a-z\s]", " ")
    return F.substring(_spaced(text), 1, KEY_LENGTH)
