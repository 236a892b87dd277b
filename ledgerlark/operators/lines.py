"""Transactions from the text lines of a statement.

Lines: statement_id, row_idx (line number from 0), line. A line of PAGE_BREAK ends a page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.amounts import AMOUNT, DATE, NUMBER, amount, line_amounts
from ledgerlark.functions.dates import line_date, tidy
from ledgerlark.sources.shared import written

from .adjacent import BLOCK, renumber
from .folds import BLOCK as FOLD_BLOCK
from .folds import with_state

PAGE_BREAK = "__PAGE_BREAK__"
# What may stand before a row's date, and the words and forms of lines that are no part of a table.
PREFIX = r"(?:\s*[0-9]+\s+)?(?:[A-Za-z0-9._/-]*[0-9][A-Za-z0-9._/-]*\s+)?"
NOISE = [
    "account statement", "statement of account", "account (s) summary", "account details", "account no. account type currency", "date description debits credits balance",
    "total records", "running balance", "opening balance", "closing balance", "summary of accounts", "account holder name", "account type", "account opened", "amount balance",
    "date ref. number description", "(incl. vat)", "please review this account statement", "within 30 days. if no issues are reported",
    "correct (subject to the bank's right to correct errors)", "to raise a complaint, contact wio bank customer service", "this bank is regulated by cbuae", "total debit", "total credit",
    "generated on", "this is a system generated", "licensed by the central bank", "customer trn", "po box",
]
NOISE_FORMS = [
    r"^from\s+[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\s+to\s+[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}\b", r"^period\s+[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\s*(?:-|to)", r"^page\s*[0-9]+(\s*of\s*[0-9]+)?$",
]
_TWO_DATES, _ONE_DATE = re.compile(rf"^{PREFIX}({DATE})\s+{DATE}\s+(.+)$"), re.compile(rf"^{PREFIX}({DATE})\s+(.+)$")
_FORMS, _ARABIC, _PAYMENT = re.compile("|".join(NOISE_FORMS), re.I), re.compile("[\u0600-\u06ff]"), re.compile(r"\bP[0-9]{6,}\b", re.I)
_ANY_DATE, _NUMBERS, _ALONE = re.compile(DATE), re.compile(f"-?{NUMBER}"), re.compile(AMOUNT, re.I)


def row_start(line: str) -> tuple[str, str] | None:
    """(date, rest) of a line that begins with a date, or two, after at most a number and a code, and goes on; else None."""
    found = _TWO_DATES.match(line) or _ONE_DATE.match(line)
    return (found[1], found[2]) if found else None


def is_noise(line: str | None) -> bool:
    """Headers, footers, summaries and page numbers; empty lines; Arabic lines without a date, a payment number or amounts."""
    lower = (line or "").lower()
    if not lower or any(w in lower for w in NOISE) or ("transaction date" in lower and "value date" in lower) or _FORMS.search(line):
        return True
    return bool(_ARABIC.search(line) and not _ANY_DATE.search(line) and not _PAYMENT.search(line) and not line_amounts(line) and len(_NUMBERS.findall(line)) < 2)


def latest(rows: DataFrame, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """rows with the last value that isn't null in this or an earlier row of the statement, under ``name``.

    A block's rows are filled by themselves; the last values of the blocks before, one for each block, fill what is left.
    """
    rows = rows.withColumns({"_value": value, "_block": F.expr(f"row_idx div {block}")})
    lasts = rows.groupBy("statement_id", "_block").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("row_idx"))).alias("_last"))
    before = Window.partitionBy("statement_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    entered = lasts.select("statement_id", "_block", F.last("_last", ignorenulls=True).over(before).alias("_entered"))
    own = Window.partitionBy("statement_id", "_block").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumn("_own", F.last("_value", ignorenulls=True).over(own)).join(entered, ["statement_id", "_block"])
    return filled.withColumn(name, F.coalesce("_own", "_entered")).drop("_value", "_block", "_own", "_entered")


# The states of the machine: no open row, or an open row by what it has.
CLOSED, BARE, WITH_AMOUNT, WITH_BALANCE, WHOLE = range(5)
BREAK, SKIP, START, TEXT = "break", "skip", "start", "text"
#: found: the line's text and amounts (null where a date stands in the place of money); has: the state of a row with them
FACTS = (
    "statement_id long, row_idx long, kind string, date string, line string, found struct<text: string, debit: bigint, credit: bigint, balance: bigint>, has int, alone boolean, value long"
)


def _state(debit: int | None, credit: int | None, balance: int | None) -> int:
    side, left = debit != 0 or credit != 0, balance != 0
    return WHOLE if side and left else WITH_AMOUNT if side else WITH_BALANCE if left else BARE


def facts(lines: DataFrame) -> DataFrame:
    """FACTS of each line, by itself: its kind, date and rest, its amounts, and whether it is one amount alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.struct([("text", pa.string()), ("debit", pa.int64()), ("credit", pa.int64()), ("balance", pa.int64())])
        for batch in batches:
            out = []
            for line in batch["line"].to_pylist():
                start = row_start(line or "")
                kind = BREAK if line == PAGE_BREAK else SKIP if is_noise(line) else START if start else TEXT
                date, rest = start if kind == START else (None, line)
                found = line_amounts(rest) if kind in (START, TEXT) else None
                alone = kind == TEXT and bool(_ALONE.fullmatch(line.strip()))
                value = amount(line) if alone else None
                out.append((kind, date, rest, found and found._asdict(), found and _state(*found[1:]), alone, value))
            kinds = [pa.string(), pa.string(), pa.string(), shape, pa.int32(), pa.bool_(), pa.int64()]
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.record_batch([batch["statement_id"], batch["row_idx"], *columns], names=["statement_id", "row_idx", "kind", "date", "line", "found", "has", "alone", "value"])

    return lines.select("statement_id", "row_idx", "line").mapInArrow(read, FACTS)


def assemble_rows(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """statement_id, row_idx (from 0), date, description, debit, credit, balance (minor units), source_line: the rows of a statement's table.

    A line with a leading date opens a row; a page break or the next such line ends it; noise is passed over. The lines
    between go on with the description, but the first that holds amounts sets them while the row has none, and a line that is
    one amount sets the missing amount (negative: debit), then the missing balance. Rows without any amount, without a
    description, or with a date for a balance are dropped. Null lines are noise.

    What the open row has is a machine of five states that meets the lines in blocks, so a statement of any length spreads.
    """

    def step(state: Column, x: Column) -> Column:
        some = F.coalesce(x["value"] != 0, F.lit(True))
        taken = F.when(state == BARE, WITH_AMOUNT).when(state != WHOLE, WHOLE).otherwise(state)
        return (
            F.when(x["kind"] == BREAK, CLOSED)
            .when(x["kind"] == START, F.coalesce(x["has"], F.lit(BARE)))
            .when((x["kind"] == SKIP) | (state == CLOSED), state)
            .when((state == BARE) & x["has"].isNotNull(), x["has"])
            .when(x["alone"] & some, taken)
            .otherwise(state)
        )

    # each is read several times: facts by every level of the machine, what follows by fills and counts
    known = written(with_state(written(facts(lines), "facts"), step, 5, CLOSED, min(block, FOLD_BLOCK)), "states")
    opening = F.when(F.col("kind") == START, F.col("row_idx")).when(F.col("kind") == BREAK, F.lit(-1))
    told = latest(known, opening, "source_line", block).where((F.col("source_line") >= 0) & F.col("kind").isin(START, TEXT))
    state, found, value, is_start = F.col("state"), F.col("found"), F.col("value"), F.col("kind") == START
    sets_all = is_start | ((state == BARE) & found.isNotNull())
    single = F.col("alone") & ~sets_all
    sets_side, sets_balance = single & state.isin(BARE, WITH_BALANCE), single & (state == WITH_AMOUNT)
    whole = lambda c: F.struct(F.when(found.isNull(), 0).otherwise(found[c]).cast("long").alias("v"))
    sides = {"debit": F.when(value < 0, -value).otherwise(0), "credit": F.when(value < 0, 0).otherwise(value)}
    events = {c: F.when(sets_all, whole(c)).when(sets_side, F.struct(v.cast("long").alias("v"))) for c, v in sides.items()}
    events["balance"] = F.when(sets_all, whole("balance")).when(sets_balance, F.struct(value.alias("v")))
    left = F.trim(F.coalesce(F.nullif(found["text"], F.lit("")), F.when(is_start, F.col("line"))))
    said = F.when(sets_all, left).when(~sets_side & ~sets_balance, F.col("line"))
    told = told.select("statement_id", "source_line", "row_idx", "date", F.nullif(said, F.lit("")).alias("said"), *[v.alias(c) for c, v in events.items()])
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("row_idx")))["v"].alias(c)
    parts = F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("row_idx", "said"))))  # one row's lines, which its description holds anyway
    rows = told.groupBy("statement_id", "source_line").agg(F.max("date").alias("date"), tidy(F.array_join(F.transform(parts, lambda p: p["said"]), " ")).alias("description"), *map(last, events))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in sides}
    kept = rows.where(((zero["debit"] != 0) | (zero["credit"] != 0) | (F.col("balance") != 0)) & (F.col("description") != "") & F.col("balance").isNotNull())
    out = kept.withColumns({**zero, "date": line_date(F.col("date"))})
    return renumber(written(out, "assembled"), block, by=("source_line",)).select("statement_id", "row_idx", "date", "description", "debit", "credit", "balance", "source_line")
