"""Tables in text against a plain loop over the lines of one document."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import tables

DATES = {"01/02/2024": "2024-02-01", "2-Feb-24": "2024-02-02", "Feb 3, 2024": "2024-02-03"}
MONEY = {"1.234,50": 123450, "1,234.50": 123450, "7": 700, "-5.25": 525, "0": None, "-": None, "": None, "x 1,000.00 CR": 100000, "0.00": 0, "R 1": 100, "01/02/2024": 102202400, "2-Feb-24": 22400, "Feb 3, 2024": 320}


def split(line):
    if "|" not in line:
        return []
    parts = [p.strip() for p in line.strip().split("|")]
    if line.strip().startswith("|") and parts[0] == "":
        parts = parts[1:]
    return parts[:-1] if line.strip().endswith("|") and parts and parts[-1] == "" else parts


def heading(cells):
    at = {}
    for i, c in enumerate(cells):
        name = {"date": "date", "txn date": "date", "value date": "value_date", "narration": "description", "debit": "debit", "credit": "credit", "balance": "balance", "chq no": "reference", "total credit": "credit"}.get(c.lower())
        if name:
            at[name] = i
    at.setdefault("date", at.get("value_date"))
    return at if at["date"] is not None and {"debit", "credit", "balance"} & set(at) and len(cells) > 2 else None


def dashes(cells):
    return bool(cells) and all(re.fullmatch(":?-{2,}:?", c) for c in cells)


def plain(text):
    rows, i, own = [], 0, [x.strip() for x in (text or "").split("\n") if x.strip()]
    while i < len(own):
        head = split(own[i])
        at = heading(head)
        if not at or i + 1 >= len(own) or not dashes(split(own[i + 1])):
            i += 1
            continue
        i += 2
        while i < len(own):
            cells = split(own[i])
            if not cells or (not dashes(cells) and len(cells) < len(head) - 2):
                break
            get = lambda name: cells[at[name]] if at.get(name) is not None and at[name] < len(cells) else ""  # noqa: B023, E731
            balance = MONEY.get(get("balance"))
            if not dashes(cells) and get("date") in DATES and balance is not None:
                special = {v for k, v in at.items() if k != "description"}
                said = get("description") or " ".join(c for k, c in enumerate(cells) if c and k not in special)
                rows.append((DATES[get("date")], said or "Transaction", get("reference") or None, MONEY.get(get("debit")) or 0, MONEY.get(get("credit")) or 0, balance))
            i += 1
    return rows


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_tables_match_a_plain_loop(spark, block):
    rng = np.random.default_rng(11)
    pick = lambda x: x[int(rng.integers(len(x)))]
    cell = lambda: pick([*DATES, *MONEY, "words", "R 1", "", ""])
    heads = ["| Date | Narration | Balance |", "Txn Date | Value Date | Narration | Chq No | Debit | Credit | Balance", "| Value Date | Debit | Balance | Other |", "| Date | words | x |", "| Date | Balance |", "|Date|Total Credit|Balance|"]
    docs = []
    for d in range(40):
        own = []
        for _ in range(int(rng.integers(0, 60))):
            kind = rng.random()
            own.append(pick(heads) if kind < 0.12 else pick(["|---|---|---|", "-- | :--: | --", "|--|"]) if kind < 0.3 else pick(["text", "", "  ", "a | b"]) if kind < 0.38 else "| " + " | ".join([pick(list(DATES)), *(cell() for _ in range(int(rng.integers(1, 8))))]) + pick([" |", ""]))
        docs.append((d, pick(["\n", "\r\n", "\n\n"]).join(own), "x"))
    docs += [(100, None, "x"), (101, "", "x"), (102, "|a|b|\n|--|--|", "x"), (103, "Date|Debit|Balance\n--|--|--", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, line string").repartition(3)
    found = tables.table_rows(tables.text_lines(df), block).orderBy("statement_id", "row_idx").collect()
    expected = [(d, n, *r) for d, text, _ in docs for n, r in enumerate(plain(text))]
    assert [tuple(r)[:-1] for r in found] == expected and len(expected) > 50


@pytest.mark.parametrize("text, value", [("1.234,50", 123450), ("1 234.5", 123450), ("1.2.3", 1230), ("5.", 500), ("-5", -500), ("5-", 500), ("a", 0), (None, 0), ("1,234,567.891", 123456789), ("AED 10", 1000)])
def test_money_of_any_locale(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(tables.money(F.col("t"))).first()[0] == value


def test_no_documents(spark):
    assert tables.table_rows(tables.text_lines(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
