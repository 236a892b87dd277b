"""Transactions from tables written in text: a source of many rows from each document.

A table is a line of at least three cells between bars whose headings name a date and a money column, a line of dashes, and
the lines after it while they have enough cells. Lines are rows of their own in Spark; which table a line belongs to follows
from a machine whose state is the cell count of the open table's heading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.dates import let, scanned_date, tidy, trimmed
from ledgerlark.functions.money import half_up
from ledgerlark.functions.references import reference_token
from ledgerlark.sources.shared import written

from .adjacent import BLOCK, following, renumber
from .folds import BLOCK as FOLD_BLOCK
from .folds import with_state
from .lines import latest

# Column headings by what they name, in order of precedence: whole headings, and parts, starts and ends of them.
HEADINGS = [
    ("value_date", ["value date", "posting date", "value dt"], "posting date"),
    ("date", ["transaction date", "txn date", "date"], "transaction date|^txn date"),
    ("description", ["narration", "description", "particular", "transaction details", "details"], "particular"),
    ("reference", ["reference", "txn id", "transaction id", "ref no", "chq ref no", "chq no", "utr"], "reference|txn id"),
    ("debit", ["debit amount", "withdrawal amount", "withdrawal amt", "dr amount", "debit"], "^debit| debit$"),
    ("credit", ["credit amount", "deposit amount", "deposit amt", "cr amount", "credit"], "^credit| credit$"),
    ("balance", ["running balance", "closing balance", "ledger balance", "available balance", "balance"], "running balance| balance$"),
]
#: A heading of this length also counts as a part of a longer one.
PARTIAL = 6
NO_TEXT = "Transaction"


def money(text: Column) -> Column:
    """Minor units of a money token in any locale: the right-most dot or comma with digits after it is the decimal point. 0 for none."""
    kept = F.regexp_replace(trimmed(F.coalesce(text, F.lit(""))), "[^0-9,.-]", "")

    def value(raw: Column) -> Column:
        unsigned = F.regexp_replace(raw, "-", "")
        whole = F.regexp_replace(F.regexp_replace(unsigned, "[.,]([0-9]*)$", ""), "[.,]", "")
        part = F.regexp_extract(unsigned, "[.,]([0-9]+)$", 1)
        number = F.when(unsigned.rlike("[.,]"), F.concat(whole, F.lit("."), part)).otherwise(unsigned)
        size = F.coalesce(half_up(F.when(number.rlike("[0-9]"), number.try_cast("double")) * 100).cast("long"), F.lit(0))
        return F.when(raw.startswith("-"), -size).otherwise(size)

    return let(kept, value)


def money_or_none(text: Column) -> Column:
    """The absolute amount of a cell, or null if it holds none: the token itself, else the first number with two decimals in it."""
    pattern = r"(-?[0-9]{1,3}(?:[., ][0-9]{3})+[.,][0-9]{2}|-?[0-9]{1,3}(?:,[0-9]{3})*\.[0-9]{2}|-?[0-9]+\.[0-9]{2})"
    inside = F.when(text.rlike(pattern), F.abs(money(F.regexp_extract(text, pattern, 1))))
    return let(F.abs(money(text)), lambda direct: F.when(F.coalesce(text, F.lit("")) != "", F.when(direct > 0, direct).otherwise(inside)))


def cells_of(line: Column) -> Column:
    """The trimmed cells of a line between bars (none without a bar); an empty one at either end is no cell."""
    clean = trimmed(line)
    inner = F.regexp_replace(F.regexp_replace(clean, r"^\|", ""), r"\|$", "")
    return F.when(F.contains(clean, F.lit("|")), F.transform(F.split(inner, r"\|"), trimmed)).otherwise(F.array().cast("array<string>"))


def is_separator(cells: Column) -> Column:
    return (F.size(cells) > 0) & F.forall(cells, lambda c: F.regexp_replace(c, r"\s+", "").rlike("^:?-{2,}:?$"))


def _named(heading: Column) -> Column:
    """What a heading names, or null."""
    clean = F.trim(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", " "))
    out = None
    for name, aliases, form in HEADINGS:
        parts = "|".join([a for a in aliases if len(a) >= PARTIAL] + [form])
        test = clean.isin(aliases) | clean.rlike(parts)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def columns_of(cells: Column) -> Column:
    """struct of the places (from 0) of each named column in a heading, the last of each name; null if it heads no table."""
    names = F.transform(cells, _named)

    def places(named: Column) -> Column:
        at = {name: F.aggregate(F.transform(named, lambda n, i: F.when(n == name, i)), F.lit(None).cast("int"), lambda a, x: F.coalesce(x, a)) for name, *_ in HEADINGS}  # noqa: B023
        at["date"] = F.coalesce(at["date"], at["value_date"])
        return F.struct(*[v.alias(k) for k, v in at.items()], F.size(named).alias("n"))

    heads = lambda p: p["date"].isNotNull() & F.coalesce(p["debit"], p["credit"], p["balance"]).isNotNull() & (p["n"] >= 3)
    return let(let(names, places), lambda p: F.when(heads(p), p))


def text_lines(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """statement_id, row_idx (from 0), line: the lines of each document that aren't blank, trimmed. A null text has none."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r", "\n"), "[ \t]", " "), "\n+", "\n")
    found = F.filter(F.transform(F.split(plain, "\n"), trimmed), lambda x: x != "")
    return documents.select(F.col(id).alias("statement_id"), F.posexplode(found).alias("row_idx", "line")).withColumn("row_idx", F.col("row_idx").cast("long"))


def table_rows(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """statement_id, row_idx (from 0), date, description, ref_number, debit, credit, balance (minor units), source_line.

    lines: as of text_lines. A table ends with a line without bars, or with two cells less than its heading at least; that line
    can head the next table. Rows whose date can't be read or that state no balance are left out, as are separators. Without a
    description column (or text in it) the cells that are no other column make the description.
    """
    cells = lines.select("statement_id", "row_idx", cells_of(F.col("line")).alias("cells")).withColumn("separates", is_separator(F.col("cells")))
    facts = following(cells, block, below=F.col("separates")).withColumn("n", F.size("cells"))
    # a heading needs its line of dashes, so few lines are read as headings
    facts = facts.withColumn("heads", F.when(F.col("below") & (F.col("n") >= 3), columns_of(F.col("cells")))).withColumn("opens", F.when(F.col("heads").isNotNull(), F.col("n")).otherwise(0))
    facts = written(facts, "facts")  # read by every level of the machine
    most = facts.agg(F.max("opens")).first()[0] or 0

    def step(state: Column, x: Column) -> Column:
        inside = (state > 0) & (x["n"] > 0) & (x["separates"] | (x["n"] >= state - 2))
        return F.when(inside, state).otherwise(x["opens"]).cast("int")

    met = with_state(facts.select("statement_id", "row_idx", "n", "separates", "opens"), step, most + 1, block=min(block, FOLD_BLOCK))
    inside = (F.col("state") > 0) & (F.col("n") > 0) & (F.col("separates") | (F.col("n") >= F.col("state") - 2))
    known = written(facts.select("statement_id", "row_idx", "cells", "heads").join(met, ["statement_id", "row_idx"]).withColumn("inside", inside), "states")
    headed = latest(known, F.when(~F.col("inside") & (F.col("opens") > 0), F.struct("heads")), "_table", block)
    rows = headed.where("inside and not separates").withColumn("at", F.col("_table.heads"))
    cell = lambda name: F.when(F.col(f"at.{name}").isNotNull(), F.get("cells", F.col(f"at.{name}")))
    special = F.array_compact(F.array(*[F.col(f"at.{name}") for name, *_ in HEADINGS if name != "description"]))
    others = F.filter("cells", lambda c, i: (c != "") & ~F.array_contains(special, i))
    own = F.coalesce(F.nullif(cell("description"), F.lit("")), F.array_join(others, " "))
    read = rows.select(
        "statement_id", F.col("row_idx").alias("source_line"), scanned_date(cell("date")).alias("date"), F.coalesce(F.nullif(tidy(F.regexp_replace(own, r"\|", " ")), F.lit("")), F.lit(NO_TEXT)).alias("description"),
        F.nullif(reference_token(cell("reference")), F.lit("")).alias("ref_number"), *[F.coalesce(money_or_none(cell(c)), F.lit(0)).alias(c) for c in ("debit", "credit")], money_or_none(cell("balance")).alias("balance"),
    )
    out = ["statement_id", "row_idx", "date", "description", "ref_number", "debit", "credit", "balance", "source_line"]
    return renumber(written(read, "read").where("date is not null and balance is not null"), block, by=("source_line",)).select(*out)
