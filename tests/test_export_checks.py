"""Checks before an export, on hand-made rows."""

from ledgerlark.operators import export_checks as checks

SCHEMA = "statement_id long, row_idx long, date string, debit long, credit long, balance long"
TRUST = "statement_id long, confidence double, fraud_flags array<string>"


def test_every_issue_is_named(spark):
    rows = [(1, 0, "5 Jun 24", -5, 0, 100), (1, 1, "soon", None, None, None), (1, 2, "2024-06-05", 0, 50, 51), (1, 3, "2024-06-05", 0, 0, 51), (1, 4, None, 0, 0, 90)]
    found = checks.checked_rows(spark.createDataFrame(rows, SCHEMA)).orderBy("row_idx").collect()
    assert [(r["date"], r["debit"], r["credit"], r["balance"], r["issues"]) for r in found] == [
        ("2024-06-05", 5, 0, 100, ["negative_amount_normalized"]), ("UNKNOWN", 0, 0, 0, ["invalid_date", "invalid_debit", "invalid_credit", "invalid_balance", "balance_major_mismatch"]),
        ("2024-06-05", 0, 50, 50, ["balance_minor_rounding_fix"]), ("2024-06-05", 0, 0, 50, ["balance_minor_rounding_fix"]), ("UNKNOWN", 0, 0, 90, ["invalid_date", "balance_major_mismatch"]),
    ]


def test_confidence_falls_with_issues_and_flags(spark):
    clean = [(s, 0, "2024-06-05", 0, 5, 100) for s in range(5)]
    rows = spark.createDataFrame([*clean, (5, 0, "x", -1, 0, 0), (6, 0, "2024-06-05", -1, 0, 0)], SCHEMA)
    trust = spark.createDataFrame([(0, 0.9, None), (1, 0.9, ["y"]), (2, 0.9, ["TAMPERED_document"]), (3, 7.0, []), (5, 0.6, None), (6, 0.43, []), (9, 1.0, None)], TRUST)
    found = {r["statement_id"]: r for r in checks.export_report(checks.checked_rows(rows), trust).collect()}
    assert {s: r["export_confidence"] for s, r in found.items()} == {0: 0.9, 1: 0.85, 2: 0.75, 3: 1.0, 4: None, 5: 0.37, 6: 0.35}
    assert [found[s]["fraud_risk"] for s in (0, 1, 2, 4)] == ["low", "medium", "high", "low"] and [found[s]["is_trusted"] for s in (4, 5, 6)] == [None, True, False]
    assert found[5]["warnings"] == ["Detected 1 major validation issue(s).", "Applied 1 minor validation fix(es)."] and found[2]["warnings"] == ["Fraud flags detected (1)."]


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert checks.export_report(checks.checked_rows(none), spark.createDataFrame([], TRUST)).count() == 0
