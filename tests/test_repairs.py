"""Repairs by the running balance and date grammars, on hand-made rows and against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import dates
from ledgerlark.operators import folds, merging, repair, statistics

SCHEMA = "statement_id long, row_idx long, date string, description string, ref_number string, debit long, credit long, balance long, own string"


def rows(spark, *values, date="2024-01-01", text="x"):
    return spark.createDataFrame([(1, i, date, text, "r", *v, "y") for i, v in enumerate(values)], SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("statement_id", "row_idx").collect()]


def test_drift_is_carried(spark):
    assert column(folds.correct_drift(rows(spark, (0, 0, 100), (0, 0, 103), (0, 0, 103), (0, 0, 120))), "corrected_balance") == [100, 100, 100, 120]


def plain_drift(values, most):
    out = []
    for d, c, b in values:
        before = out[-1] if out else None
        expected = None if before is None or b is None else before + abs(c or 0) - abs(d or 0)
        out.append(expected if expected is not None and abs(b - expected) <= most else b)
    return out


@pytest.mark.parametrize("block", [2, 3, 7, 512])
def test_recurrences_for_any_block_size(spark, block):
    rng = np.random.default_rng(block)
    statements = []
    for s in range(4):
        own, at = [], 1000
        for _ in range([0, 1, 40, 130][s]):
            d, c = (int(rng.integers(0, 50)) if rng.random() < 0.7 else None for _ in "dc")
            at += (c or 0) - (d or 0) + int(rng.integers(-3, 4)) * int(rng.integers(0, 4))
            own.append((d, c, None if rng.random() < 0.05 else at))
        statements.append(own)
    df = spark.createDataFrame([(s, i, "", "", "", *v, "y") for s, own in enumerate(statements) for i, v in enumerate(own)], SCHEMA).repartition(3)
    assert column(folds.correct_drift(df, block=block), "corrected_balance") == [b for own in statements for b in plain_drift(own, 10)]
    exported = [plain_drift([(d or 0, c or 0, b or 0) for d, c, b in own], 1) for own in statements]
    found = folds.repair_export(df, block=block)
    assert column(found, "repaired_balance") == [b for own in exported for b in own]
    issues = []
    for own, fixed in zip(statements, exported):
        for i, (d, c, b) in enumerate(own):
            off = fixed[i - 1] + (c or 0) - (d or 0) - (b or 0) if i else 0
            issues.append(None if not off else folds.MINOR_FIX if abs(off) == 1 else folds.MAJOR_MISMATCH)
    assert column(found, "issue") == issues


def test_summary_of_an_export(spark):
    r = folds.repair_summary(folds.repair_export(rows(spark, (0, 0, 100), (0, 0, 101), (0, 0, 200), (0, 0, 200)))).first()
    assert (r["mismatches"], r["minor_fixes"], r["major_mismatches"], r["mismatch_ratio"], r["is_valid"]) == (2, 1, 1, 2 / 3, False)


def test_swapped_side(spark):
    fixed = repair.correct_sides(rows(spark, (0, 500, 10000), (0, 2500, 7500)))
    assert column(fixed, "debit") == [0, 2500] and column(fixed, "credit") == [500, 0] and column(fixed, "is_swapped") == [False, True]


def test_edge_row_by_narration_and_by_opening_balance(spark):
    hinted = rows(spark, (700, 0, 10000), (0, 100, 10100)).withColumn("description", F.expr("if(row_idx = 0, 'SALARY march', 'x')"))
    assert column(repair.correct_sides(hinted), "credit") == [700, 100]
    both = hinted.withColumn("description", F.lit("salary payment"))
    assert column(repair.correct_sides(both), "credit") == [0, 100]
    headers = spark.createDataFrame([(1, 9300)], "statement_id long, opening_balance long")
    assert column(repair.swap_edge_by_opening(both, headers), "credit") == [700, 100]
    assert column(repair.swap_edge_by_opening(both, headers.where("false")), "credit") == [0, 100]


def test_reverse_statements(spark):
    df = rows(spark, (0, 5, 15), (0, 10, 10), (0, 0, 0), date=None)
    assert repair.direction(df).first()["direction"] == "reverse"
    dated = df.withColumn("date", F.expr("concat('0', 5 - row_idx, '/01/24')"))
    assert repair.direction(dated).first()["direction"] == "reverse" and repair.direction(dated.withColumn("balance", F.lit(None).cast("long"))).first()["direction"] == "reverse"
    assert repair.row_order(dated).first()["row_order"] == "reverse"
    assert repair.direction(rows(spark, (0, 5, 15))).first()["direction"] == "forward"


def test_slipped_decimal_point(spark):
    fixed = repair.harmonize(rows(spark, (0, 500, 1000000), (250, 0, 750000)))
    assert column(fixed, "debit") == [0, 250000] and column(fixed, "is_harmonized") == [False, True]


def plain_repaired(x, target):
    if x <= 0 or target <= 0:
        return x
    digits = str(x).zfill(3)
    found = [x * 10, x * 100, x * 1000] + [math.floor(x / k + 0.5) for k in (10, 100, 1000)]
    found += [int(digits[:i] + str(d) + digits[i + 1 :]) for i in range(len(digits)) for d in range(10)]
    best = x
    for c in found:
        if c > 0 and abs(c - target) < abs(best - target):
            best = c
    return best if abs(best - target) <= max(200, target * 0.05) else x


def test_repaired_amounts(spark):
    rng = np.random.default_rng(1)
    pairs = [(0, 5), (5, 0), (5, 500), (12345, 12845), (99, 990), (600, 800), (7, 10 ** 6)] + [(int(rng.integers(1, 10 ** int(rng.integers(1, 8)))), int(rng.integers(1, 10**6))) for _ in range(200)]
    df = spark.createDataFrame(pairs, "x long, t long").select("x", "t", repair.repaired_amount(F.col("x"), F.col("t")).alias("y"))
    assert all(r["y"] == plain_repaired(r["x"], r["t"]) for r in df.collect())


def test_rows_are_validated_by_the_step(spark):
    df = rows(spark, (-5, None, 1000), (0, 0, 1500), (300, 0, 1200), (800, 0, 600), (9, 9, 600), (70, 0, None), (0, 123000, 13000))
    found = repair.validate_rows(df)
    assert column(found, "debit") == [-5, 0, 300, 600, 9, 70, 0] and column(found, "credit") == [None, 500, 0, 0, 9, 0, 123000]
    assert column(found, "balance_inferred") == [False, True, False, False, False, False, False]
    assert column(found, "low_confidence") == [False, False, False, False, False, True, True]


def test_offsets_need_agreement(spark):
    df = rows(spark, (0, 500, 1500), (0, 100, 1600))
    headers = lambda a, b: spark.createDataFrame([(1, a, b)], "statement_id long, opening_balance long, closing_balance long")
    offset = lambda a, b: [r["balance_offset"] for r in repair.balance_offsets(df, headers(a, b)).collect()]
    assert (offset(1003, 1603), offset(1003, 1604), offset(1003, 1605), offset(None, 1605), offset(1000, None), offset(1011, None), offset(None, None)) == ([3], [4], [], [5], [], [], [])
    assert column(repair.apply_offsets(df, headers(1003, 1603)), "balance") == [1503, 1603]


FORMS = {
    "5/6/24": "2024-06-05", "05-06-2024": "2024-06-05", "5 Jun 2024": "2024-06-05", "Jun 5, 2024": "2024-06-05", "June 2024": "2024-06-01", "2024/6/5": "2024-06-05",
    "31/02/2024": "2024-02-31", "01/01/49": "2049-01-01", "01/01/50": "1950-01-01", "2024-06-05T10:00": "2024-06-05", " 5  jun,  24 ": "2024-06-05", "5/6/999": "0999-06-05",
    "13/13/2024": None, "1/2/3": None, "5 Foo 2024": None, "": None, None: None, "x 05/06/2024": None, "\u0001\u0001": None, "99/99/9999999999": None,
}


def test_statement_dates(spark):
    df = spark.createDataFrame([(t,) for t in FORMS], "t string")
    assert {r["t"]: r["d"] for r in df.select("t", dates.statement_date(F.col("t")).alias("d")).collect()} == FORMS
    days = {r["t"]: r["d"] and str(r["d"]) for r in df.select("t", dates.statement_day(F.col("t")).alias("d")).collect()}
    assert days["31/02/2024"] == "2024-03-02" and days["June 2024"] == "2024-06-01" and days[None] is None


def test_grammars_disagree(spark):
    read = lambda t, f: (lambda v: v if v is None or isinstance(v, (str, bool)) else str(v))(spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0])
    assert [read(t, dates.merge_day) for t in ("12/25/2024", "5/6/24", "13/13/2024", "5 Jun 24")] == ["2024-12-25", "1924-06-05", "2025-01-13", "2024-06-05"]
    assert [read(t, lambda c: dates.scanned_date(c, F.lit("2023"))) for t in ("07-Jan-07", "7 Jan", "Jan 7", "1/2/99", "7 Foo")] == ["2023-01-07", "2023-01-07", "2023-01-07", "1999-02-01", None]
    assert [read(t, dates.scanned_date) for t in ("07-Jan-07", "7 Jan", "45/13/2024")] == ["2007-01-07", None, "2024-13-45"]
    assert [read(t, dates.line_date) for t in ("5 Foo 2024", "5/6/007", "  odd  text ", "45/1/2024")] == ["2024-undefined-05", "2007-06-05", "odd text", "45/1/2024"]
    assert read("5 Foo 2024", lambda c: dates.line_date(c, names_checked=True)) == "5 Foo 2024"
    assert [read(t, dates.ledger_day) for t in ("1/1/50", "2024-02-31", "5/6/999", "0024-01-05", "5 Jun 24")] == ["2050-01-01", "2024-03-02", None, "0024-01-05", "2024-06-05"]
    assert [read(t, dates.period_day) for t in ("45/1/2024", "2024-13-01")] == ["2024-02-14", "2025-01-01"]
    assert [read(t, dates.coded_date) for t in ("1/1/50", "Jan 5", None)] == ["2050-01-01", "UNKNOWN", "UNKNOWN"]
    assert [read(t, dates.embedded_date) for t in ("on 05/06/2024", "2024/06/05!", "5/6/24", None)] == ["2024-06-05", "2024-06-05", "5/6/24", ""]
    assert [read(t, dates.is_packed_date) for t in ("050624", "05062024", "20240605", "20241305", "1234567", "991224", None)] == [True, True, True, False, False, False, False]


def test_order_of_dates_skips_what_cannot_be_read(spark):
    df = rows(spark, *[(0, 0, 0)] * 4)
    order = lambda *days: tuple(statistics.date_order(df.join(spark.createDataFrame(list(enumerate(days)), "row_idx long, d string"), "row_idx").withColumn("date", F.col("d"))).first())[1:]
    assert order("2024-05-01", None, "2024-01-01", "2024-06-01") == (0.5, 0.0)
    assert order(None, "x", "", None) == (0.0, 0.0) and order("1 May 2024", "x", "", None) == (0.0, 1.0)
    assert order("01/05/2024", "x", "3 May 2024", "May 9, 2024") == (0.0, 1.0)


def test_merge_of_overlapping_files(spark):
    lines = [(1, 0, 0, "2024-01-02", "A", 5, 0, 10), (1, 0, 1, "x", "", 1, 0, 9), (1, 1, 0, "01/01/2024", "B", 0, 7, 3), (1, 1, 1, "2024-01-02", "A", 5, 0, None), (1, 1, 2, None, None, None, None, None)]
    df = spark.createDataFrame(lines, "group_id long, file_idx long, row_idx long, date string, ref_number string, debit long, credit long, balance long")
    head = "group_id long, file_idx long, file_name string, bank_name string, account_number string, currency string, account_holder string, statement_period string, closing_balance long"
    heads = spark.createDataFrame([(1, 0, "a", "Bank", "1-2", "INR", None, None, None), (1, 1, "b", "bank.", "12", "", "Me", "1/1/2024 to 5/1/2024", 77), (2, 0, "c", "", "1", "X", None, "", None)], head)
    for block in (1, 2, 1000):
        merged = merging.merge_rows(df, block).orderBy("row_idx").collect()
        assert [(r["row_idx"], r["file_idx"], r["file_row"]) for r in merged] == [(0, 1, 0), (1, 0, 0), (2, 1, 1), (3, 0, 1), (4, 1, 2)]
    found = {r["group_id"]: r for r in merging.merge_summary(df, heads).collect()}
    assert tuple(found[1])[1:] == (5, 1, 11, 7, "01/01/2024 to 2024-01-02", 77, "Bank", "1-2", "INR", "Me")
    assert tuple(found[2])[1:] == (0, 0, 0, 0, None, None, None, "1", "X", None)
    why = {r["group_id"]: (r["can_merge"], r["reasons"]) for r in merging.merge_eligibility(heads).collect()}
    assert why == {1: (False, ["Missing currency in b"]), 2: (False, ["Only one statement uploaded", "Missing bank name in c"])}


def test_repairs_of_nothing(spark):
    none = rows(spark, (1, 2, 3)).where("false")
    headers = spark.createDataFrame([], "statement_id long, opening_balance long, closing_balance long")
    for run in (folds.correct_drift, folds.repair_export, repair.direction, repair.correct_sides, repair.harmonize, repair.lock_columns, repair.validate_rows, repair.row_order, repair.settle_sides, statistics.date_order):
        assert run(none).count() == 0
    assert repair.apply_offsets(none, headers).count() == 0 and repair.swap_edge_by_opening(none, headers).count() == 0
    one = rows(spark, (None, None, None), date=None, text=None)
    for run in (folds.correct_drift, folds.repair_export, repair.correct_sides, repair.harmonize, repair.lock_columns, repair.validate_rows, repair.settle_sides):
        assert run(one).count() == 1


def test_repaired_amounts_of_any_size_without_lists_of_candidates(spark):
    rng = np.random.default_rng(7)
    pairs = [(10**16 + 12345, 10**16 + 62345), (9 * 10**18, 2**63 - 1), (2**63 - 1, 1), (100, 1), (None, 5), (5, None), (-5, 7), (20, 25), (1999, 2000), (500, 1)]
    pairs += [(int(rng.integers(1, 10 ** int(rng.integers(1, 19)))), int(rng.integers(1, 10 ** int(rng.integers(1, 19))))) for _ in range(500)]
    pairs += [(t + int(rng.integers(-9, 10)) * 10 ** int(rng.integers(0, 6)), t) for t in rng.integers(1, 10**6, 500).tolist()]
    df = spark.createDataFrame(pairs, "x long, t long").select("x", "t", repair.repaired_amount(F.col("x"), F.col("t")).alias("y"))

    def plain(x, t):  # all candidates, as a long can hold them
        if x is None or t is None or x <= 0 or t <= 0:
            return x
        text = str(x).rjust(3, "0")
        edits = [int(text[:i] + str(d) + text[i + 1 :]) for i in range(len(text)) for d in range(10)]
        every = [x] + [y for y in [x * 10, x * 100, x * 1000, *[int(x / k + 0.5) for k in (10, 100, 1000)], *edits] if 0 < y < 2**63]
        best = min(every, key=lambda y: abs(y - t))
        return best if abs(best - t) <= max(200.0, t * 0.05) else x

    assert all(r["y"] == plain(r["x"], r["t"]) for r in df.collect())
    assert "sequence(" not in df._jdf.queryExecution().toString()
