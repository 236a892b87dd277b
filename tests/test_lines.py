"""Amounts in lines, and rows assembled from lines, against a plain loop over one statement."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import amounts
from ledgerlark.operators import lines


@pytest.mark.parametrize("token, value", [
    ("1,234.50", 123450), ("(12.00)", -1200), ("12.00 DR", -1200), ("-12.00CR", 0), ("-12.00 CR", 1200), ("", 0), (None, 0), ("abc", 0), ("5/6/2024", None), ("5 Jun 2024", None),
    ("050624", None), ("20240605", None), ("123456", 12345600), ("1.005", 101), ("0.0049", 0), ("12,34,567.8", 123456780), ("(5/6/24)", None), ("1234567", 123456700),
])
def test_amount(token, value):
    assert amounts.amount(token) == value


@pytest.mark.parametrize("line, found", [
    ("Coffee shop 12.50 - 987.50", ("Coffee shop", 1250, 0, 98750)), ("Salary ACME 1,000.00 1,987.50", ("Salary ACME", 0, 100000, 198750)), ("atm 20 80", ("atm", 2000, 0, 8000)),
    ("- 20.00 1,742.50", ("", 0, 2000, 174250)), ("10.00 - 1,727.50", ("", 1000, 0, 172750)), ("1.00 2.00 3.00", ("", 100, 200, 300)), ("words only", None), ("one 5", None),
    ("x 5.00 DR then 7.00", ("x then", 500, 0, 700)), ("Refund (rate: 3.67) 1.00 2.00, 3.00;", ("Refund", 100, 200, 300)), ("paid in May 2024 5.00 6.00", ("paid in May 2024", 0, 500, 600)),
    ("a – 5 9", ("a", 0, 500, 900)), ("fee (7.00) 9.00 -", ("fee", 700, 900, 900)), ("x 5/6/2024 9.00 8.00", ("x 5/6/2024", 0, 900, 800)), ("x 050624 8.00", ("x", None, 0, 800)),
])
def test_amounts_of_a_line(line, found):
    assert amounts.line_amounts(line) == found


def test_starts_and_noise():
    assert lines.row_start("00274626 04-02-2024 876201 - x") == ("04-02-2024", "876201 - x")
    assert lines.row_start("01/02/2024 02/02/2024 text") == ("01/02/2024", "text") and lines.row_start("Jan 5, 2024 text") == ("Jan 5, 2024", "text")
    assert lines.row_start("ref 2024 of 01/02/2024 text more") is None and lines.row_start("01/02/2024") is None
    noise = ["", None, "Page 2 of 9", "page 7", "Your Opening Balance 5.00", "Transaction date | Value Date", "From 1/2/24 to 3/4/24", "period 1/2/24 - 3/4/24", "كشف حساب"]
    assert all(map(lines.is_noise, noise)) and not any(map(lines.is_noise, ["shop", "pages of text", "حساب 1.00 2.00", "حساب P1234567", "حساب 1/2/2024", "page seven"]))


POOL = [
    "01/02/2024 Coffee 12.50 - 987.50", "02/02/2024 Wire out", "3 Feb 2024 only words here", "03/02/2024 050624 8.00", "04/02/2024 Free 0.00 0.00 0.00", "continued", "more  text", "(250.00)", "75.00", "0.00", "050624",
    "note 5.00 60.00", "- 20.00 1,742.50", "Page 2 of 9", "__PAGE_BREAK__", None, "", "05/02/2024 7.00", "x 1.00 050624",
]


def plain_rows(own):
    out, row = [], None

    def flush():
        nonlocal row
        if row and any(row[k] not in (0, "date") for k in "dcb"):  # what is no number counts for nothing
            text = re.sub(r"\s+", " ", " ".join(row["said"])).strip()
            if text and row["b"] != "date":
                out.append((row["date"], text, 0 if row["d"] == "date" else row["d"], 0 if row["c"] == "date" else row["c"], row["b"], row["at"]))
        row = None

    named = lambda v: "date" if v is None else v
    for at, line in enumerate(own):
        if line == lines.PAGE_BREAK:
            flush()
            continue
        if lines.is_noise(line):
            continue
        if start := lines.row_start(line):
            flush()
            found = amounts.line_amounts(start[1])
            d, c, b = map(named, found[1:]) if found else (0, 0, 0)
            row = {"date": start[0], "said": [(found and found.text) or start[1]], "d": d, "c": c, "b": b, "at": at}
            continue
        if row is None:
            continue
        found = amounts.line_amounts(line)
        if found and row["d"] == row["c"] == row["b"] == 0:
            row["d"], row["c"], row["b"] = map(named, found[1:])
            row["said"] += [found.text] if found.text else []
        elif re.fullmatch(amounts.AMOUNT, line.strip(), re.I):
            value = amounts.amount(line)
            if row["d"] == 0 and row["c"] == 0:
                if value is not None and value < 0:
                    row["d"] = -value
                else:
                    row["c"] = named(value)
            elif row["b"] == 0:
                row["b"] = named(value)
            else:
                row["said"].append(line)
        else:
            row["said"].append(line)
    flush()
    return out


@pytest.mark.parametrize("block", [2, 5, 1 << 16])
def test_rows_match_a_plain_loop(spark, block):
    rng = np.random.default_rng(block)
    statements = [[POOL[i] for i in rng.integers(0, len(POOL), n)] for n in (0, 1, 30, 200)]
    df = spark.createDataFrame([(s, i, line, 1) for s, own in enumerate(statements) for i, line in enumerate(own)], "statement_id long, row_idx long, line string, kind int").repartition(3)
    found = lines.assemble_rows(df, block).orderBy("statement_id", "row_idx").collect()
    iso = {"01/02/2024": "2024-02-01", "02/02/2024": "2024-02-02", "3 Feb 2024": "2024-02-03", "03/02/2024": "2024-02-03", "04/02/2024": "2024-02-04", "05/02/2024": "2024-02-05"}
    expected = [(s, n, iso[r[0]], *r[1:]) for s, own in enumerate(statements) for n, r in enumerate(plain_rows(own))]
    assert [tuple(r) for r in found] == expected and len(expected) > 20


def test_latest_across_blocks(spark):
    values = [None, 3, None, None, 5, None, None, None, None, 7]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "statement_id long, row_idx long, v int")
    expected = list(itertools.accumulate(values, lambda a, b: a if b is None else b))
    for block in (1, 2, 3, 100):
        assert [r["last"] for r in lines.latest(df, F.col("v"), "last", block).orderBy("row_idx").collect()] == expected
