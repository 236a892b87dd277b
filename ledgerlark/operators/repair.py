"""Repair of amounts and sides by the running balance.

Balances stay as they are, so each row is judged by itself, its own balance and that of a neighbour: the row before, or the
row after where a statement lists its newest row first. All money is in minor units.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerlark.functions.dates import ledger_day, let, statement_day
from ledgerlark.functions.money import half_up

from .adjacent import following, previous, renumber
from .cleaning import normalize_signs

# Words that tell the side of an amount; single letters stand alone.
CREDIT_HINTS = [" cr ", "credit", "deposit", "salary", "received", "inward", "refund", "reversal", "interest", "cashback", "transfer in"]
DEBIT_HINTS = [" dr ", "debit", "withdraw", "atm", "charges", "fee", "commission", "purchase", "pos", "emi", "payment", "transfer out"]
# Factors of slipped decimal points, and the shares and units that a repair may leave over.
SCALES, RESIDUAL, RESIDUAL_UNITS = [0.01, 0.1, 10, 100, 1000], 0.002, 2
FORWARD, REVERSE = "forward", "reverse"


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _rounded(x: Column) -> Column:
    return half_up(x).cast("long")


def neighbours(ledger: DataFrame) -> DataFrame:
    """Ledger rows with _prev and _next, the balances of the rows before and after."""
    return following(previous(ledger, _prev=F.col("balance")), _next=F.col("balance"))


def _off(near: Column, debit: Column, credit: Column) -> Column:
    """What a row's balance is off from its neighbour's, given its amounts; null without both."""
    return F.abs(near + credit - debit - F.col("balance"))


def direction(ledger: DataFrame) -> DataFrame:
    """statement_id, direction, n_rows: whether a statement runs forward or in reverse.

    Dates decide if at least two neighbouring pairs of different readable dates go one way, and twice as many as go the
    other. Else the way in which balances are off by less in total does; fewer than two checks either way mean forward.
    """
    day = ledger_day(F.col("date"))
    rows = following(previous(ledger.withColumn("_day", day), _prev=F.col("balance"), _before=F.col("_day")), _next=F.col("balance"))
    off = lambda near: _off(F.col(near), _zero("debit"), _zero("credit"))
    found = rows.groupBy("statement_id").agg(
        F.count_if(F.col("_day") > F.col("_before")).alias("up"), F.count_if(F.col("_day") < F.col("_before")).alias("down"),
        F.sum(off("_prev")).alias("ahead"), F.count(off("_prev")).alias("n_ahead"), F.sum(off("_next")).alias("back"), F.count(off("_next")).alias("n_back"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    up, down, ahead, back = (F.col(c) for c in ("up", "down", "n_ahead", "n_back"))
    way = (
        F.when((up >= 2) & (up >= 2 * down), FORWARD)
        .when((down >= 2) & (down >= 2 * up), REVERSE)
        .when((ahead < 2) & (back < 2), FORWARD)
        .when(ahead == 0, REVERSE)
        .when((back > 0) & (F.col("back") < F.col("ahead")), REVERSE)
        .otherwise(FORWARD)
    )
    return found.select("statement_id", way.alias("direction"), "n_rows")


def directed(ledger: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """Ledger rows with direction, _near (the balance of the neighbour that a row follows from) and _edge (the row without one)."""
    rows = neighbours(ledger).join(direction(ledger) if ways is None else ways, "statement_id")
    forward = F.col("direction") == FORWARD
    edge = F.col("row_idx") == F.when(forward, 0).otherwise(F.col("n_rows") - 1)
    return rows.withColumns({"_near": F.when(forward, F.col("_prev")).otherwise(F.col("_next")), "_edge": edge}).drop("_prev", "_next")


def _swap_is_better(near: Column, debit: Column, credit: Column) -> Column:
    """Whether the amounts on the other side fit the balances clearly better and leave little over."""
    one_side = (debit > 0) != (credit > 0)

    def judge(x: Column) -> Column:
        stated, swapped = x["stated"], x["swapped"]
        little = F.greatest(F.lit(RESIDUAL_UNITS), _rounded(F.greatest(debit, credit) * RESIDUAL))
        return (stated - swapped >= 2) & (swapped + 1 < stated) & ((swapped <= little) | (swapped <= _rounded(stated * 0.2)))

    offs = F.struct(_off(near, debit, credit).alias("stated"), _off(near, credit, debit).alias("swapped"))
    return F.coalesce(one_side & judge(offs), F.lit(False))


def hinted_side(description: Column) -> Column:
    """credit or debit by the words of a narration; null if neither or both have a word in it."""
    words = F.regexp_replace(F.lower(F.coalesce(description, F.lit(""))), "[^a-z0-9]+", " ")
    padded = F.concat(F.lit(" "), F.trim(words), F.lit(" "))
    says = lambda hints: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(padded, h))
    return let(F.struct(says(CREDIT_HINTS).alias("c"), says(DEBIT_HINTS).alias("d")), lambda x: F.when(x["c"] & ~x["d"], "credit").when(x["d"] & ~x["c"], "debit"))


def _swapped(rows: DataFrame, swap: Column) -> DataFrame:
    return rows.withColumns({"debit": F.when(swap, F.col("credit")).otherwise(F.col("debit")), "credit": F.when(swap, F.col("debit")).otherwise(F.col("credit"))})


def correct_sides(ledger: DataFrame) -> DataFrame:
    """Ledger rows with debit and credit on the side that the balances show, direction and is_swapped.

    Signs are normalised first. The edge row has no neighbour to follow from, so its narration decides. A statement of one
    row only has its signs normalised.
    """
    rows = directed(normalize_signs(ledger))
    debit, credit = F.col("debit"), F.col("credit")
    hint = hinted_side(F.col("description"))
    wrong = ((hint == "credit") & (debit > 0) & (credit == 0)) | ((hint == "debit") & (credit > 0) & (debit == 0))
    swap = F.when(F.col("_edge"), F.coalesce(wrong, F.lit(False)) & (F.col("n_rows") > 1)).otherwise(_swap_is_better(F.col("_near"), debit, credit))
    return _swapped(rows.withColumn("is_swapped", swap), F.col("is_swapped")).drop("_near", "_edge", "n_rows")


def swap_edge_by_opening(ledger: DataFrame, headers: DataFrame) -> DataFrame:
    """Ledger rows, the edge row's sides swapped where that fits the opening balance of headers (statement_id, opening_balance) better.

    A missing balance of the edge row is zero; without an opening balance nothing changes.
    """
    rows = directed(ledger).join(headers.select("statement_id", F.col("opening_balance").alias("_opening")), "statement_id", "left")
    stated = rows.withColumns({"_own": F.col("balance"), "balance": _zero("balance")})
    swap = F.col("_edge") & _swap_is_better(F.col("_opening"), _zero("debit"), _zero("credit"))
    return _swapped(stated.withColumn("_swap", swap), F.col("_swap")).withColumn("balance", F.col("_own")).drop("_own", "_swap", "_opening", "_near", "_edge", "n_rows", "direction")


# The largest offset of all balances that is removed, and what two measures of it may differ by.
MOST_OFFSET, OFFSETS_AGREE = 10, 1


def balance_offsets(ledger: DataFrame, headers: DataFrame) -> DataFrame:
    """statement_id, balance_offset: what all balances of a statement lack against its header's opening and closing balance.

    headers: statement_id, opening_balance, closing_balance. Both measures must agree within a unit, or only one be known;
    at most MOST_OFFSET units count, and the mean of two rounds up at a half. Statements without such an offset are absent.
    """
    edges = ledger.groupBy("statement_id").agg(
        F.min_by(F.struct("balance", _zero("debit").alias("debit"), _zero("credit").alias("credit")), "row_idx").alias("first"), F.max_by(F.struct("balance"), "row_idx").alias("last")
    )
    known = edges.join(headers.select("statement_id", "opening_balance", "closing_balance"), "statement_id")
    start = F.col("opening_balance") - (F.col("first.balance") - F.col("first.credit") + F.col("first.debit"))
    end = F.col("closing_balance") - F.col("last.balance")
    found = known.select("statement_id", start.alias("a"), end.alias("b"))
    both = F.when((F.abs(F.col("a") - F.col("b")) <= OFFSETS_AGREE) & (F.abs("a") <= MOST_OFFSET), _rounded((F.col("a") + F.col("b")) / 2))
    one = F.coalesce("a", "b")
    offset = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), both).when(F.abs(one) <= MOST_OFFSET, one)
    return found.select("statement_id", offset.cast("long").alias("balance_offset")).where("balance_offset <> 0")


def apply_offsets(ledger: DataFrame, headers: DataFrame) -> DataFrame:
    """Ledger rows with the statement's balance_offset added to every balance."""
    rows = ledger.join(balance_offsets(ledger, headers), "statement_id", "left")
    return rows.withColumn("balance", F.col("balance") + _zero("balance_offset")).drop("balance_offset")


def _pair(debit: Column, credit: Column) -> Column:
    return F.struct(F.greatest(F.lit(0), debit).cast("long").alias("debit"), F.greatest(F.lit(0), credit).cast("long").alias("credit"))


def _harmonized(near: Column, debit: Column, credit: Column) -> Column:
    """struct(debit, credit): the amounts that fit the balances, from the first of the best candidates; the stated ones if none fits well."""
    none = F.lit(0)
    step = F.col("balance") - near
    moved, seen = F.abs(step), F.greatest(F.abs(debit), F.abs(credit))
    only_d, only_c = (debit > 0) & (credit == 0), (credit > 0) & (debit == 0)

    def slipped(scale: Column) -> Column:
        x = _rounded(seen * scale)
        d, c = F.when(only_d, x).otherwise(0), F.when(only_c, x).otherwise(0)
        return F.array(_pair(d, c), _pair(c, d))

    scaled = F.flatten(F.transform(F.array(*[F.lit(float(k)) for k in SCALES]), slipped))
    ratio = F.try_divide(moved, seen)
    slip, close = (seen >= 100_000) & ((ratio >= 8) | (ratio <= 0.125)), (seen > 0) & ratio.between(0.4, 2.5)
    whole = F.when(slip | close, F.array(F.when(step > 0, _pair(none, moved)).otherwise(_pair(moved, none))))
    stay, no_more = F.array(_pair(debit, credit), _pair(credit, debit)), F.slice(scaled, 1, 0)
    candidates = F.concat(stay, F.when(only_d | only_c, scaled).otherwise(no_more), F.coalesce(whole, no_more))
    ranked = F.transform(candidates, lambda x, i: F.struct(_off(near, x["debit"], x["credit"]).alias("off"), i.alias("i"), x.alias("pair")))
    stated = _off(near, debit, credit)

    def accept(best: Column) -> Column:
        little = F.greatest(F.lit(RESIDUAL_UNITS), _rounded(F.greatest(debit, credit, moved) * RESIDUAL))
        fits = (step != 0) & (best["off"] + 4 < stated) & ((best["off"] <= little) | (best["off"] <= _rounded(stated * 0.15)))
        return F.when(fits, best["pair"]).otherwise(F.struct(debit.cast("long").alias("debit"), credit.cast("long").alias("credit")))

    kept = F.struct(debit.cast("long").alias("debit"), credit.cast("long").alias("credit"))
    return F.when(stated.isNull(), kept).otherwise(let(F.array_min(ranked), accept))


def harmonize(ledger: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """Ledger rows with amounts that the step of the balance supports, direction and is_harmonized.

    Candidates in order: as stated, sides swapped, the amount with its decimal point moved on either side, and the step
    itself if the amount is near it or far off by a power of ten. The first of those that leave least is taken if it leaves
    little and clearly less than the stated amounts. A second pass over the result settles what the first has brought near.
    """
    rows = directed(ledger.withColumns({c: _zero(c) for c in ("debit", "credit")}), ways)
    near = F.when(~F.col("_edge"), F.col("_near"))
    for name, before in (("_first", None), ("_second", "_first")):
        debit, credit = (F.col(c) if before is None else F.col(f"{before}.{c}") for c in ("debit", "credit"))
        rows = rows.withColumn(name, _harmonized(near, debit, credit))
    changed = (F.col("_second.debit") != F.col("debit")) | (F.col("_second.credit") != F.col("credit"))
    rows = rows.withColumn("is_harmonized", changed).withColumns({"debit": F.col("_second.debit"), "credit": F.col("_second.credit")})
    return rows.drop("_first", "_second", "_near", "_edge", "n_rows")


# What a digit repair may leave over (minor units, or a share of the target), and what a validated row may.
REPAIR_UNITS, REPAIR_SHARE, ROW_TOLERANCE = 200, 0.05, 100
MOST = 2**63 - 1


def repaired_amount(observed: Column, target: Column) -> Column:
    """The amount nearest to the target among the observed one, its powers of ten, and all edits of one of its digits.

    Ties go to the first: ten, a hundred and a thousand times, then as many parts, then edits from the left, digits
    ascending. If even that leaves over two units of money and 5 % of the target, the observed amount stays, as it does without
    a target. Null and non-positive amounts stay.
    """
    return _nearest_amount(observed.cast("long"), target.cast("long"))


@F.arrow_udf(LongType())
def _nearest_amount(observed: pa.Array, target: pa.Array) -> pa.Array:
    known = pc.fill_null(pc.and_(pc.greater(observed, 0), pc.greater(target, 0)), False)
    at = np.flatnonzero(known.to_numpy(zero_copy_only=False))
    x, goal = (pc.fill_null(a, 0).to_numpy(zero_copy_only=False)[at] for a in (observed, target))
    best, off = x.copy(), np.abs(x - goal)

    def offer(y: np.ndarray, fits: np.ndarray) -> None:
        less = fits & (y > 0) & (np.abs(y - goal) < off)
        best[less], off[less] = y[less], np.abs(y - goal)[less]

    for k in (10, 100, 1000):
        offer(x * k, x <= MOST // k)
    for k in (10, 100, 1000):
        offer(np.floor(x / k + 0.5).astype(np.int64), np.ones(len(x), dtype=bool))
    for place in reversed(range(max(3, len(str(x.max()))) if len(x) else 0)):
        worth = 10**place
        inside, here = (x >= worth) | (place < 3), x // worth % 10
        # of the ten digits only those next to the target can be nearest, the lower one first
        digit = here + (goal - x) // worth
        for d in (digit, digit + 1):
            more = (np.clip(d, 0, 9) - here) * worth
            offer(x + more, inside & (more <= MOST - x))
    good = off <= np.maximum(float(REPAIR_UNITS), goal * REPAIR_SHARE)
    out = pc.fill_null(observed, 0).to_numpy(zero_copy_only=False).copy()
    out[at[good]] = best[good]
    return pc.if_else(pc.is_null(observed), pa.scalar(None, pa.int64()), pa.array(out))


def supported_amount(debit: Column, credit: Column, moved: Column, side: Column) -> Column:
    """The amount of one row that the step of its balance supports, each side repaired by its digits; 0 if both sides are 0.

    Of two amounts the nearer counts, and one as near (within a unit) if it stands on the preferred side.
    """
    d, c = repaired_amount(debit, moved), repaired_amount(credit, moved)
    off_d, off_c = F.abs(d - moved), F.abs(c - moved)
    second = (off_c < off_d) | ((F.abs(off_c - off_d) <= 1) & (side == "credit"))
    return F.when((debit > 0) & (credit > 0), F.when(second, c).otherwise(d)).when(debit > 0, d).when(credit > 0, c).otherwise(0)


def _onto_side(rows: DataFrame, amount: Column, credit: Column, when: Column) -> DataFrame:
    """The amount on one side where ``when`` holds, the other side 0."""
    rows = rows.withColumns({"_amount": amount, "_credit": credit, "_when": F.coalesce(when, F.lit(False))})
    put = lambda c, here: F.when(F.col("_when"), F.when(here, F.col("_amount")).otherwise(0)).otherwise(F.col(c))
    return rows.withColumns({"debit": put("debit", ~F.col("_credit")), "credit": put("credit", F.col("_credit"))}).drop("_amount", "_credit", "_when")


def lock_columns(ledger: DataFrame) -> DataFrame:
    """Ledger rows (newest last) with one amount each, on the side of the balance's step; rows without a step or an amount stay."""
    rows = previous(ledger, _prev=F.col("balance"))
    step = F.col("balance") - F.col("_prev")
    debit, credit = F.abs(_zero("debit")), F.abs(_zero("credit"))
    amount = supported_amount(debit, credit, F.abs(step), F.when(step > 0, "credit").otherwise("debit"))
    return _onto_side(rows, amount, step > 0, (step != 0) & ((debit > 0) | (credit > 0))).drop("_prev")


def validate_rows(ledger: DataFrame) -> DataFrame:
    """Ledger rows (newest last) with amounts checked against the balance's step, and the tags low_confidence and balance_inferred.

    A row that is off by more than ROW_TOLERANCE takes the step as its amount if it has none, else the supported amount on
    the step's side, if that leaves it within the tolerance. What can't be repaired or checked is of low confidence.
    """
    rows = previous(ledger.withColumns({"_d": F.col("debit"), "_c": F.col("credit"), **{c: F.abs(_zero(c)).cast("long") for c in ("debit", "credit")}}), _prev=F.col("balance"))
    debit, credit, step = F.col("debit"), F.col("credit"), F.col("balance") - F.col("_prev")
    moved, empty = F.abs(step), (debit <= 0) & (credit <= 0)
    amount = F.when(empty, moved).otherwise(supported_amount(debit, credit, moved, F.when(step >= 0, "credit").otherwise("debit")))
    rows = rows.withColumns({"_step": step, "_fits": _off(F.col("_prev"), debit, credit) <= ROW_TOLERANCE, "_empty": empty, "_sum": amount})
    repairable = F.coalesce(~F.col("_fits") & (F.col("_step") != 0) & (F.col("_sum") > 0), F.lit(False))
    # with the amount on the step's side, a row is off by their difference
    solved = repairable & (F.abs(F.col("_sum") - F.abs("_step")) <= ROW_TOLERANCE)
    low = (F.col("row_idx") > 0) & ~solved & ~F.coalesce("_fits", F.lit(False))
    rows = rows.withColumns({"balance_inferred": solved & F.col("_empty"), "low_confidence": low, "_put": repairable})
    rows = _onto_side(rows, F.col("_sum"), F.col("_step") > 0, F.col("_put"))
    unseen = F.col("_step").isNull()
    rows = rows.withColumns({"debit": F.when(unseen, F.col("_d")).otherwise(F.col("debit")), "credit": F.when(unseen, F.col("_c")).otherwise(F.col("credit"))})
    return rows.drop("_prev", "_step", "_fits", "_empty", "_sum", "_put", "_d", "_c")


def row_order(ledger: DataFrame) -> DataFrame:
    """statement_id, row_order (chron or reverse), n_rows: by 60 % of the moves of readable dates, else by which way fewer sides look swapped.

    Dates need three readable ones and two moves; reversed reading must save more than one swapped side.
    """
    dated = ledger.select("statement_id", "row_idx", statement_day(F.col("date")).alias("day")).where("day is not null")
    moves = previous(renumber(dated), before=F.col("day")).groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("n_dated"), F.count_if(F.col("day") > F.col("before")).alias("up"), F.count_if(F.col("day") < F.col("before")).alias("down")
    )
    swapped = lambda near: F.count_if(_off(F.col(near), _zero("credit"), _zero("debit")) + 1 < _off(F.col(near), _zero("debit"), _zero("credit")))
    sides = neighbours(ledger).groupBy("statement_id").agg(swapped("_prev").alias("ahead"), swapped("_next").alias("back"), F.count(F.lit(1)).alias("n_rows"))
    most = F.ceil((F.col("up") + F.col("down")) * 0.6)
    by_dates = F.when((F.col("n_dated") >= 3) & (F.col("up") + F.col("down") >= 2), F.when(F.col("up") >= most, "chron").when(F.col("down") >= most, "reverse"))
    found = F.coalesce(by_dates, F.when(F.col("back") + 1 < F.col("ahead"), "reverse").otherwise("chron"))
    return sides.join(moves, "statement_id", "left").select("statement_id", F.when(F.col("n_rows") < 2, "chron").otherwise(found).alias("row_order"), "n_rows")


def settle_sides(ledger: DataFrame, fill: bool = False) -> DataFrame:
    """Ledger rows with row_order, and single amounts moved to the side of the balance's step where that settles the row.

    With fill, rows without an amount take the step as theirs, and rows with both keep the larger on the step's side.
    """
    rows = neighbours(ledger.withColumns({c: _zero(c).cast("long") for c in ("debit", "credit")})).join(row_order(ledger).drop("n_rows"), "statement_id")
    near = F.when(F.col("row_order") == "reverse", F.col("_next")).otherwise(F.col("_prev"))
    rows = rows.withColumn("_near", near)
    debit, credit, step = F.col("debit"), F.col("credit"), F.col("balance") - F.col("_near")
    stated, swapped = _off(F.col("_near"), debit, credit), _off(F.col("_near"), credit, debit)
    amount = F.when(credit > 0, credit).otherwise(debit)
    can = (swapped + 1 < stated) & (stated - swapped >= 2) & (swapped <= F.greatest(F.lit(2.0), amount * RESIDUAL))
    wrong = ((step > 0) & (credit == 0) & (debit > 0)) | ((step < 0) & (debit == 0) & (credit > 0))
    rows = _onto_side(rows, amount, step > 0, (amount > 0) & can & wrong)
    if fill:
        neither, both = (debit == 0) & (credit == 0), (debit > 0) & (credit > 0)
        rows = _onto_side(rows, F.when(neither, F.abs(step)).otherwise(F.greatest(debit, credit)), step > 0, (step != 0) & (neither | both))
    return rows.drop("_prev", "_next", "_near")

