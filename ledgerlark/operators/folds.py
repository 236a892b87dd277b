"""Recurrences over a statement's rows whose state takes few values, without a statement in one task.

A machine of S states meets the rows in order; each row sends every state to a state. A block of rows is then a map of S
numbers, whatever the state in which it is entered, and maps compose. Blocks are folded to their maps side by side, the maps
of neighbouring blocks to maps of larger ones until one is left, and the states in which blocks are entered follow from the
top down. Every task holds one block of rows or of maps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.sources.shared import written

from .adjacent import previous

BLOCK = 512
Step = Callable[[Column, Column], Column]


def _compose(items: Column, step: Step, states: int) -> Column:
    """The map of a run of items: for each entering state, the state after them."""
    same = F.array(*[F.lit(s) for s in range(states)])
    return F.aggregate(items, same, lambda m, x: F.transform(m, lambda s: step(s, x)))


def _walk(items: Column, enter: Column, step: Step) -> Column:
    """The state in which each item is met."""
    start = F.struct(enter.alias("now"), F.expr("cast(array() as array<int>)").alias("met"))
    return F.aggregate(items, start, lambda a, x: F.struct(step(a["now"], x).alias("now"), F.concat(a["met"], F.array(a["now"])).alias("met")), lambda a: a["met"])


def _through(state: Column, item: Column) -> Column:
    return F.element_at(item["map"], state + 1)


def _entered(maps: DataFrame, states: int, start: int, block: int, last: int) -> DataFrame:
    """maps: statement_id, at (from 0), map -> statement_id, at, enter. last: the largest ``at``."""
    items = F.array_sort(F.collect_list(F.struct("at", "map")))
    groups = maps.groupBy("statement_id", F.expr(f"at div {block}").alias("up")).agg(items.alias("items"))
    if last < block:
        groups = groups.withColumn("enter", F.lit(start))
    else:
        above = groups.select("statement_id", F.col("up").alias("at"), _compose(F.col("items"), _through, states).alias("map"))
        groups = groups.join(_entered(above, states, start, block, last // block).withColumnRenamed("at", "up"), ["statement_id", "up"])
    met = F.arrays_zip(F.col("items.at").alias("at"), _walk(F.col("items"), F.col("enter"), _through).alias("enter"))
    return groups.select("statement_id", F.inline(met).alias("at", "enter"))


def with_state(rows: DataFrame, step: Step, states: int, start: int = 0, block: int = BLOCK, name: str = "state") -> DataFrame:
    """All rows and columns, and the machine's state (int, 0 to states - 1) before each row, under ``name``.

    rows: statement_id, row_idx (long, from 0 without gaps in each statement), other columns of types that can be compared.
    step(state, row): the state after the row, never null; row is a struct of the columns. A statement begins in ``start``.
    The number of levels follows from the longest statement, which one job looks up.
    """
    columns = [c for c in rows.columns if c != "statement_id"]
    longest = rows.agg(F.max("row_idx")).first()[0]
    items = F.array_sort(F.collect_list(F.struct("row_idx", *[c for c in columns if c != "row_idx"])))
    blocks = rows.groupBy("statement_id", F.expr(f"row_idx div {block}").alias("at")).agg(items.alias("items"))
    if (longest or 0) < block:
        blocks = blocks.withColumn("enter", F.lit(start))
    else:
        maps = blocks.select("statement_id", "at", _compose(F.col("items"), step, states).alias("map"))
        maps = written(maps, "maps")  # every level reads the one below it twice
        blocks = blocks.join(_entered(maps, states, start, block, longest // block), ["statement_id", "at"])
    met = F.arrays_zip(F.col("items").alias("row"), _walk(F.col("items"), F.col("enter"), step).alias("met"))
    return blocks.select("statement_id", F.inline(met).alias("row", "met")).select("statement_id", *[F.col(f"row.{c}").alias(c) for c in columns], F.col("met").alias(name))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _carried(ledger: DataFrame, balance: Column, most: int, block: int) -> DataFrame:
    """Ledger rows with _gap (what the row's own step is off before any repair, null without both balances) and _offset.

    The carried balance is the stated one plus an offset of at most ``most`` units either way, and that is the state. A row
    whose gap agrees with the offset before it up to ``most`` units takes the expected balance and passes its own offset on;
    any other row keeps its balance and passes none on.
    """
    gap = balance - F.col("_before") - (_zero("credit") - _zero("debit"))
    rows = previous(ledger, _before=balance).withColumn("_gap", gap).drop("_before")

    def after(state: Column, gap: Column) -> Column:
        offset = state - most - gap
        return F.when(F.abs(offset) <= most, offset + most).otherwise(most).cast("int")

    met = with_state(rows, lambda s, r: F.coalesce(after(s, r["_gap"]), F.lit(most)), 2 * most + 1, most, block, "_state")
    return met.withColumn("_offset", F.coalesce(after(F.col("_state"), F.col("_gap")), F.lit(most)) - most)


def correct_drift(ledger: DataFrame, most: int = 10, block: int = BLOCK) -> DataFrame:
    """Ledger rows with corrected_balance and is_corrected: small drifts of the balance (at most ``most`` minor units) undone.

    A row's expected balance is the corrected one before it plus credit less debit. If the stated balance is off by
    ``most`` units or less, the expected one takes its place, also for the rows after it; after a larger difference or a
    missing balance the stated balance counts again. Missing amounts are zero, signs of amounts are dropped.
    """
    known = ledger.withColumns({c: F.abs(_zero(c)).cast("long") for c in ("debit", "credit")})
    rows = _carried(known, F.col("balance"), most, block)
    return rows.withColumns({"corrected_balance": F.col("balance") + F.col("_offset"), "is_corrected": F.col("_offset") != 0}).drop("_gap", "_offset", "_state")


# The units that an export repairs, the share of mismatches up to which it is valid, and the issues' codes.
EXPORT_TOLERANCE, EXPORT_MISMATCHES = 1, 0.2
MINOR_FIX, MAJOR_MISMATCH = "balance_minor_rounding_fix", "balance_major_mismatch"


def repair_export(ledger: DataFrame, block: int = BLOCK) -> DataFrame:
    """Ledger rows with repaired_balance, issue (null if the balance is as expected) and issue_difference (expected less stated).

    The expected balance follows from the repaired one before it. One unit is a rounding fix, and carried on; more is a
    major mismatch, and the stated balance stays. Missing amounts and balances are zero.
    """
    rows = _carried(ledger, _zero("balance"), EXPORT_TOLERANCE, block)
    off = F.col("_state") - EXPORT_TOLERANCE - F.col("_gap")  # what was carried in, less the row's own gap
    issue = F.when(off != 0, F.when(F.abs(off) <= EXPORT_TOLERANCE, MINOR_FIX).otherwise(MAJOR_MISMATCH))
    return rows.withColumns({"repaired_balance": _zero("balance") + F.col("_offset"), "issue": issue, "issue_difference": F.when(off != 0, off)}).drop("_gap", "_offset", "_state")


def repair_summary(repaired: DataFrame) -> DataFrame:
    """Per statement: mismatches, minor fixes, major mismatches, the mismatch ratio of its steps, and whether it is valid."""
    counted = repaired.groupBy("statement_id").agg(
        F.count("issue").alias("mismatches"), F.count_if(F.col("issue") == MINOR_FIX).alias("minor_fixes"), F.count_if(F.col("issue") == MAJOR_MISMATCH).alias("major_mismatches"),
        (F.count("issue") / F.greatest(F.lit(1), F.count(F.lit(1)) - 1)).alias("mismatch_ratio"),
    )
    return counted.withColumn("is_valid", F.col("mismatch_ratio") <= EXPORT_MISMATCHES)
