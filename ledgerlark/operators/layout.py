"""Lines and money columns of pages whose text comes as placed tokens.

Tokens: statement_id, page (from 1), x, y (double, from the lower left), text. What depends on the order of positions (a line's first token,
the running centre of a column) is streamed: Spark deals tokens by page or statement and sorts them, a task keeps one line or one centre.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.amounts import amount, is_amount, side_of
from ledgerlark.functions.dates import tidy
from ledgerlark.sources.shared import plain_unions, written

# How far tokens of a line lie apart in y, columns in x, and an amount from its column; the headings of columns.
LINE_GAP, COLUMN_GAP, REACH = 2.5, 24.0, 70.0
CREDIT_HEADING, DEBIT_HEADING, BALANCE_HEADING = r"\b(?:credit|credits|deposit|deposits|cr)\b", r"\b(?:debit|debits|withdrawal|withdrawals|dr)\b", r"\b(?:balance|balances)\b"
LINES = "statement_id long, page int, line int, text string, tokens array<struct<x: double, text: string>>"
LAYOUT = "statement_id long, debit_center double, credit_center double, balance_center double, source string"
_TOKENS = pa.list_(pa.struct([("x", pa.float64()), ("text", pa.string())]))


def group_lines(tokens: DataFrame) -> DataFrame:
    """LINES of each page, from the top: the tokens at most LINE_GAP below a line's first token, from left to right.

    Tokens are taken from the top, those as high from the left. Blank and null tokens are left out, missing positions are 0.
    """
    known = tokens.select("statement_id", F.col("page").cast("int").alias("page"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in "xy"], tidy(F.col("text")).alias("text")).where("text <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = itertools.chain.from_iterable(zip(*[b[c].to_pylist() for c in ("statement_id", "page", "y", "x", "text")]) for b in batches)
        for (statement, page), own in itertools.groupby(stream, key=lambda t: t[:2]):
            line, top, held, out = 0, None, [], []
            for _, _, y, x, text in itertools.chain(own, [(0, 0, None, 0, None)]):
                if top is not None and (y is None or top - y > LINE_GAP):
                    held.sort(key=lambda t: t[0])
                    out.append((statement, page, line, " ".join(t for _, t in held), [{"x": a, "text": t} for a, t in held]))
                    line, top, held = line + 1, None, []
                top = y if top is None else top
                held.append((x, text))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.string(), _TOKENS))]
            yield pa.record_batch(columns, names=["statement_id", "page", "line", "text", "tokens"])

    dealt = known.repartition("statement_id", "page").sortWithinPartitions("statement_id", "page", F.desc("y"), "x", "text")
    return written(dealt.mapInArrow(run, LINES), "lines")  # columns are found and amounts read from several passes over lines


def _bare(text: str) -> str:
    return re.sub("[,:;]+$", "", text).strip()


def _amounts_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [is_amount(_bare(t)) for t in batch["text"].to_pylist()]
        yield batch.filter(pa.array(found, pa.bool_()))


def detect_layout(lines: DataFrame) -> DataFrame:
    """LAYOUT of each statement that has one: by the first line with headings of debit, credit and balance, else by where amounts stand.

    Amounts are clustered from left to right: one more than COLUMN_GAP beyond the running mean of the cluster begins the next. Of
    three clusters or more, the last three are debit, credit and balance.
    """
    plain_unions(lines.sparkSession)
    place = lambda pattern: F.get(F.filter("tokens", lambda t: F.lower(t["text"]).rlike(pattern)), 0)["x"]
    labels = lines.select("statement_id", F.struct("page", "line").alias("at"), place(DEBIT_HEADING).alias("debit_center"), place(CREDIT_HEADING).alias("credit_center"), place(BALANCE_HEADING).alias("balance_center"))
    headed = labels.where("debit_center is not null and credit_center is not null and balance_center is not null")
    headed = headed.groupBy("statement_id").agg(F.min_by(F.struct("debit_center", "credit_center", "balance_center"), "at").alias("c")).select("statement_id", "c.*", F.lit("header").alias("source"))
    headed = written(headed, "headed")
    places = lines.join(headed.select("statement_id"), "statement_id", "left_anti").select("statement_id", F.explode("tokens").alias("t")).select("statement_id", "t.x", "t.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = itertools.chain.from_iterable(zip(b["statement_id"].to_pylist(), b["x"].to_pylist()) for b in batches)
        for statement, own in itertools.groupby(stream, key=lambda t: t[0]):
            centers, n, total = [], 0, 0
            for _, x in own:
                total += 1
                if not centers or abs(x - centers[-1]) > COLUMN_GAP:
                    centers, n = [*centers[-3:], x], 1
                    continue
                centers[-1] = (centers[-1] * n + x) / (n + 1)
                n += 1
            last = sorted(centers)[-3:]
            if total >= 3 and len(last) == 3:
                yield pa.record_batch([pa.array([statement]), *(pa.array([c]) for c in last), pa.array(["fallback"])], names=["statement_id", "debit_center", "credit_center", "balance_center", "source"])

    numbers = places.mapInArrow(_amounts_only, "statement_id long, x double, text string").select("statement_id", "x")
    found = headed.unionByName(numbers.repartition("statement_id").sortWithinPartitions("statement_id", "x").mapInArrow(run, LAYOUT))
    return written(found, "layout")  # of known size: where it is small, lines are joined with it where they are


def _anchored(tokens: list[tuple[float, str]], text: str, debit: float, credit: float, balance: float) -> tuple[int, int, int] | None:
    """(debit, credit, balance) of one line by the columns that its amounts stand nearest to, or None."""
    numbers = [t for t in tokens if is_amount(_bare(t[1]))]
    money = [t for t in numbers if min(abs(t[0] - debit), abs(t[0] - credit)) <= REACH]
    near = lambda some, center: min(some, key=lambda t: abs(t[0] - center), default=None)
    value = lambda t: amount(t[1]) or 0

    def sided(t: tuple[float, str]) -> tuple[int, int]:
        to_debit, to_credit = abs(t[0] - debit), abs(t[0] - credit)
        if to_debit != to_credit:
            return (abs(value(t)), 0) if to_debit < to_credit else (0, abs(value(t)))
        d, c = side_of(text, amount(t[1]))
        return d or 0, c

    last = near([t for t in numbers if abs(t[0] - balance) <= REACH], balance)
    if last is None:
        one = near(money, min(debit, credit))
        return (*sided(one), 0) if one else None
    left = [t for t in money if t is not last]
    if len(numbers) == 2:
        return (*sided(left[0]), abs(value(last))) if left else None
    in_debit = near([t for t in left if abs(t[0] - debit) <= REACH], debit)
    in_credit = near([t for t in left if t is not in_debit and abs(t[0] - credit) <= REACH], credit)
    d, c = abs(value(in_debit)) if in_debit else 0, abs(value(in_credit)) if in_credit else 0
    if not d and not c:
        rest = [t for t in left if t is not in_debit and t is not in_credit]
        one = rest[0] if len(rest) == 1 else left[0] if left else None
        d, c = sided(one) if one else (0, 0)
    return d, c, abs(value(last))


def anchored_amounts(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """statement_id, page, line, debit, credit, balance (minor units): the lines whose amounts stand in their statement's columns.

    The amount nearest to the balance column (REACH at most) is the balance; of two amounts, the other goes to the nearer of
    debit and credit, or by the words of the line if it is as near to both; of more, the nearest to each. Amounts away from all
    columns are references. Without a balance, the amount nearest to the left column counts, and the balance is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = _anchored([(t["x"], t["text"]) for t in r["tokens"]], r["text"], r["debit_center"], r["credit_center"], r["balance_center"])
                if found:
                    out.append((r["statement_id"], r["page"], r["line"], *found))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["statement_id", "page", "line", "debit", "credit", "balance"])

    joined = lines.join(layouts.drop("source"), "statement_id")
    return joined.mapInArrow(run, "statement_id long, page int, line int, debit long, credit long, balance long")
