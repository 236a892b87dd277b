"""What an export checks first: rows made whole, every issue named, and how far the result can be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.dates import NO_DATE, statement_date
from ledgerlark.functions.money import clamp, half_up

from .folds import BLOCK, MAJOR_MISMATCH, MINOR_FIX, repair_export

# Issues of single rows, those that are minor, flags that weigh more, and the least confidence.
INVALID_DATE, INVALID_AMOUNT, NEGATIVE = "invalid_date", "invalid_{}", "negative_amount_normalized"
MINOR_ISSUES = [NEGATIVE, MINOR_FIX]
CRITICAL_FLAGS = ["tampered_document", "edited_timestamp_mismatch", "high_conflict_reconciliation"]
LEAST_CONFIDENCE = 0.35


def prepare_rows(ledger: DataFrame) -> DataFrame:
    """Ledger rows ready for a file, none left out, with issues (array of codes).

    Dates become ISO text or UNKNOWN. Missing amounts and balances become 0, negative amounts lose their sign. Each such repair
    is an issue of the row, in the order date, debit, credit, balance, sign.
    """
    iso = statement_date(F.col("date"))
    negative = F.coalesce(F.col("debit") < 0, F.lit(False)) | F.coalesce(F.col("credit") < 0, F.lit(False))
    found = [F.when(iso.isNull(), INVALID_DATE), *[F.when(F.col(c).isNull(), INVALID_AMOUNT.format(c)) for c in ("debit", "credit", "balance")], F.when(negative, NEGATIVE)]
    size = {c: F.abs(F.coalesce(c, F.lit(0))).cast("long") for c in ("debit", "credit")}
    return ledger.withColumns({"issues": F.array_compact(F.array(*found)), "date": F.coalesce(iso, F.lit(NO_DATE)), **size, "balance": F.coalesce("balance", F.lit(0))})


def checked_rows(ledger: DataFrame, block: int = BLOCK) -> DataFrame:
    """prepare_rows with the balance repaired (see repair_export) and its issue at the end of issues."""
    repaired = repair_export(prepare_rows(ledger), block)
    issues = F.concat("issues", F.when(F.col("issue").isNotNull(), F.array("issue")).otherwise(F.array().cast("array<string>")))
    return repaired.withColumns({"issues": issues, "balance": F.col("repaired_balance")}).drop("repaired_balance", "issue", "issue_difference")


def fraud_risk(flags: Column) -> Column:
    critical = F.exists(flags, lambda f: F.lower(f).isin(CRITICAL_FLAGS))
    return F.when(F.coalesce(critical, F.lit(False)), "high").when(F.size(flags) > 0, "medium").otherwise("low")


def export_confidence(confidence: Column, minor: Column, major: Column, flags: Column) -> Column:
    """The confidence of a statement less what its issues and fraud flags take, 0 to 1, to two decimals."""
    less = F.when(minor > 0, 0.08).otherwise(0.0) + F.when(major > 0, F.least(F.lit(0.35), 0.1 + major * 0.05)).otherwise(0.0)
    less = less + F.when(F.size(flags) > 0, 0.05).otherwise(0.0) + F.when(fraud_risk(flags) == "high", 0.1).otherwise(0.0)
    # least and greatest would pass over a null
    return F.when(confidence.isNotNull(), clamp(half_up((clamp(confidence, 0.0, 1.0) - less) * 100) / 100, 0.0, 1.0))


def export_report(checked: DataFrame, statements: DataFrame) -> DataFrame:
    """Per statement of checked rows: n_rows, flagged_rows, major and minor issues, fraud_risk, export_confidence, is_trusted, warnings.

    statements: statement_id, confidence (double), fraud_flags (array of text; null: none). A statement that is absent there or
    has no confidence can't be exported and has a null export_confidence. Trust needs more than LEAST_CONFIDENCE.
    """
    minor = F.size(F.filter("issues", lambda x: x.isin(MINOR_ISSUES)))
    counted = checked.groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size("issues") > 0).alias("flagged_rows"), F.sum(F.size("issues") - minor).alias("major_issues"), F.sum(minor).alias("minor_issues")
    )
    known = counted.join(statements.select("statement_id", "confidence", F.coalesce("fraud_flags", F.array().cast("array<string>")).alias("flags")), "statement_id", "left")
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    found = known.withColumns({"flags": flags}).withColumns({"fraud_risk": fraud_risk(F.col("flags")), "export_confidence": export_confidence(F.col("confidence"), F.col("minor_issues"), F.col("major_issues"), F.col("flags"))})
    warnings = F.array(
        F.when(F.col("major_issues") > 0, F.format_string("Detected %d major validation issue(s).", "major_issues")), F.when(F.col("minor_issues") > 0, F.format_string("Applied %d minor validation fix(es).", "minor_issues")),
        F.when(F.size("flags") > 0, F.format_string("Fraud flags detected (%d).", F.size("flags"))),
    )
    return found.withColumns({"is_trusted": F.col("export_confidence") > LEAST_CONFIDENCE, "warnings": F.array_compact(warnings)}).drop("flags", "confidence")
