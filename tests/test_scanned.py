"""Scanned rows: numbers, clean-up and confidence, on hand-made rows."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import scanned

NUMBERS = {
    "1,234.56": 123456, "1.234,56": 123456, "12,34,567.8": None, "12,34,567": None, "1,23,456.78": None, "1O0.00": 10000, "5l2.9B": 51298, "1,234.56-": -123456, "-7": -700, "1,234": 123, "1,234,567": None,
    "1,234,567.89": 123456789, "1.2.3": None, "12.3456": None, "--5": None, "5-5": None, "": None, None: None, "abc": None, "AED 10": 1000, "1.005": 101, "0.5": 50, ".5": None, "-": None, "1,23": 123,
}
RAW = "statement_id long, row_idx long, date string, description string, ref_number string, debit string, credit string, balance string, amount string, type string"


def plain(text):
    """The same rule with searches and splits."""

    raw = (text or "").strip()
    if raw.endswith("-") and not raw.startswith("-"):
        raw = "-" + raw[:-1]
    if re.search("[A-Za-z]", raw) and re.search("[0-9]", raw):
        raw = raw.translate(str.maketrans(*scanned.MISREAD))
    kept = re.sub("[^0-9,.-]", "", raw)
    bare = kept.removeprefix("-")
    if "-" in bare or not any(re.fullmatch(f, bare) for f in scanned.NUMBER_FORMS):
        return None
    point = max(".,", key=bare.rfind) if re.search("[.,]", bare) else None
    if point and bare.count(point) != 1:
        return None
    whole, part = bare.split(point) if point else (bare, "0")
    value = int((float(re.sub("[.,]", "", whole) + "." + part) * (-1 if kept.startswith("-") else 1)) * 100 // 0.5 + 1) // 2
    return value


def test_strict_numbers(spark):
    df = spark.createDataFrame([(t,) for t in NUMBERS], "t string").select("t", scanned.strict_number(F.col("t")).alias("n"))
    found = {r["t"]: r["n"] for r in df.collect()}
    assert found == {t: plain(t) for t in NUMBERS}
    assert {t: n for t, n in found.items() if t in ("1,234.56", "1.234,56", "1O0.00", "1,234.56-", "1,234", "1,234,567", "AED 10")} == {"1,234.56": 123456, "1.234,56": 123456, "1O0.00": 10000, "1,234.56-": -123456, "1,234": 123, "1,234,567": None, "AED 10": 1000}


def test_rows_are_cleaned_repaired_and_scored(spark):
    rows = [
        (1, 0, "01/02/2024", " Shop  one ", "REF AE12345", "", "", "1000.00", None, None), (1, 1, "soon", "x", None, "1", None, "5", None, None), (1, 2, "2 Feb", "x", None, "1", None, "5", None, None),
        (1, 3, "02-Feb-24", "Page 3", None, "10.00", None, "99O.00", None, "DR"), (1, 4, "03/02/24", "both", None, "5.00", "20.00", "1010.00", None, "credit"), (1, 5, "04/02/24", "typed", None, None, None, "1000.00", "10", "Dr"),
        (1, 6, "05/02/24", "nothing", None, None, None, None, None, None), (1, 7, "05/02/24", "no balance", None, "3.00", None, None, None, None), (2, 0, "05/02/24", "fine", None, None, "3.00", None, None, None),
    ]
    df = spark.createDataFrame(rows, RAW)
    found = scanned.normalize_scanned(df).orderBy("statement_id", "row_idx").collect()
    assert [(r["raw_row"], r["date"], r["description"], r["debit"], r["credit"], r["balance"], r["low_confidence"]) for r in found] == [
        (0, "2024-02-01", "Shop one", 0, 0, 100000, False), (3, "2024-02-02", "UNREADABLE", 1000, 0, 99000, True), (4, "2024-02-03", "both", 0, 2000, 101000, False), (5, "2024-02-04", "typed", 1000, 0, 100000, False),
        (7, "2024-02-05", "no balance", 300, 0, None, True), (0, "2024-02-05", "fine", 0, 300, None, True),
    ]
    assert found[0]["ref_number"] == "AE12345"
    scored = scanned.scanned_rows(df)
    assert [r["confidence"] for r in scored.orderBy("statement_id", "row_idx").collect()] == [70, 25, 100, 100, 25, 70]
    summary = {r["statement_id"]: r for r in scanned.scan_summary(scored).collect()}
    assert (summary[1]["n_rows"], summary[1]["avg_confidence"], summary[1]["issues"]) == (5, 0.64, ["low_confidence_rows:3", "unreadable_rows:1"])
    assert scanned.scanned_rows(df.where("false")).count() == 0


@pytest.mark.parametrize("balance, score", [(100, 100), (120, 100), (121, 90), (200, 90), (201, 65), (None, 25)])
def test_points_for_a_balance_that_does_not_follow(spark, balance, score):
    rows = [(1, 0, "a", 0, 50, 50, False), (1, 1, "b", 0, 50, balance, balance is None)]
    df = spark.createDataFrame(rows, "statement_id long, row_idx long, description string, debit long, credit long, balance long, low_confidence boolean")
    assert scanned.with_confidence(df).where("row_idx = 1").first()["confidence"] == score


def test_patterns_of_a_number_are_not_repeated(spark):
    plan = spark.range(1).select(scanned.strict_number(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 10 and plan.count("RLIKE") <= 8
    rows = spark.createDataFrame([(1, 0, "01/02/2024", "shop", "REF AE12345", "5", "", "1000.00", None, None)], RAW)
    plan = scanned.normalize_scanned(rows)._jdf.queryExecution().optimizedPlan().toString()  # parsed rows are read, not parsed again for each filter and count
    assert scanned.MISREAD[0] not in plan
