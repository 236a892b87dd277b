"""Rows that say the same: repeats within one extraction, and the rows of two extractions of one document.

Groups whose members depend on the order are streamed: rows are dealt by group and sorted by Spark, and a task keeps what the
group has left so far, not its rows.
"""

from __future__ import annotations

import bisect
import itertools
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.dates import scanned_date
from ledgerlark.sources.shared import plain_unions, written

from .adjacent import BLOCK, renumber

# How far balances of matched rows may lie apart (minor units).
MATCH_UNITS = 200
LEDGER = "date string, description string, ref_number string, debit long, credit long, balance long"
_COLUMNS = [c.split()[0] for c in LEDGER.split(", ")]


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_key(text: Column) -> Column:
    """Lower-case letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def reference_key(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), "[^A-Z0-9]", "")


def quality() -> Column:
    """How much a row's narration and reference tell."""
    text, ref = F.trim(_text("description")), F.trim(_text("ref_number"))
    told = F.least(F.length(text), F.lit(80)) + F.when(ref != "", F.least(F.length(ref), F.lit(24)) + 6).otherwise(0)
    mixed = F.when(ref.rlike("[A-Za-z]") & ref.rlike("[0-9]"), 10).otherwise(0)
    spaced = F.when(F.length(ref) - F.length(F.regexp_replace(ref, r"\s", "")) > 2, 8).otherwise(0)
    short = F.when(F.size(F.split(text, r"\s+")) <= 4, 6).otherwise(0)
    return told + mixed - spaced - short


def best_of_repeats(ledger: DataFrame) -> DataFrame:
    """One row for each statement, date, amounts and balance, in the place of the first (``position``, its row_idx).

    The row of the best quality stays. Among equals the first does, unless a later one's narration is longer and contains
    it: each such row takes the place of the one before. Missing amounts and balances are zero here.
    """
    date = F.trim(_text("date"))
    rows = ledger.withColumns({"_date": date, "_d": _zero("debit"), "_c": _zero("credit"), "_b": _zero("balance"), "_quality": quality(), "_words": words_key(F.col("description"))})
    key = ["statement_id", "_date", "_d", "_c", "_b"]
    # of equal narrations only the first can stay, so a key comes together as its different narrations
    told = rows.groupBy(*key, "_quality", "_words").agg(F.min("row_idx").alias("at"))
    tops = told.groupBy(*key).agg(F.max("_quality").alias("_quality"), F.min("at").alias("position"))
    equals = told.join(tops, [*key, "_quality"]).groupBy(*key, "position").agg(F.array_sort(F.collect_list(F.struct("at", "_words"))).alias("all"))
    longer = lambda a, b: (F.length(b["_words"]) > F.length(a["_words"])) & F.contains(b["_words"], a["_words"])
    last = F.aggregate(F.col("all"), F.get("all", 0), lambda a, b: F.when(longer(a, b), b).otherwise(a))
    chosen = equals.select("statement_id", "position", last["at"].alias("row_idx"))
    return ledger.join(chosen, ["statement_id", "row_idx"])


class Bucket:
    """The rows that a bucket keeps so far, found by reference and by narration."""

    def __init__(self):
        self.rows: list[tuple[int, str, str]] = []  # row_idx, reference, narration
        self.by_ref: dict[str, set[int]] = {}
        self.by_text: dict[str, set[int]] = {}
        self.bare: dict[str, set[int]] = {}  # without a reference, by narration

    def _index(self, i: int, add: bool) -> None:
        _, ref, text = self.rows[i]
        for table, key in ((self.by_ref, ref), (self.by_text, text), (self.bare, None if ref else text)):
            if key is not None:
                (table.setdefault(key, set()).add if add else table[key].discard)(i)

    def add(self, at: int, ref: str, text: str) -> None:
        """A row joins the first that is likely the same, by reference if both have one, else by narration; or stays itself."""
        if ref:
            same = self.by_ref.get(ref, set()) | (self.bare.get(text, set()) if text else set())
        else:
            same = self.by_text.get(text, set()) if text else self.bare.get("", set())
        if not same:
            self.rows.append((at, ref, text))
            self._index(len(self.rows) - 1, True)
            return
        i = min(same)
        _, own_ref, own_text = self.rows[i]
        if (ref and not own_ref) or (bool(ref) == bool(own_ref) and len(text) > len(own_text) + 4):
            self._index(i, False)
            self.rows[i] = (at, ref, text)
            self._index(i, True)


def drop_likely_repeats(ledger: DataFrame, block: int = BLOCK) -> DataFrame:
    """Ledger rows without likely repeats, numbered anew, with kept_row (the old row_idx).

    Rows of one statement, date, amounts and balance form a bucket. In statement order, each row joins the first kept row
    that has its reference (if both have one) or its narration (if one has no reference); of the two, the one with a
    reference stays, else the one whose narration is longer by more than four characters, else the kept one. Buckets stand
    in the order of their first rows. A row that repeats the reference and narration of its bucket's row before
    changes nothing, so such rows go before anything is shuffled by bucket.
    """
    bucket = {"_date": F.trim(_text("date")), "_d": _zero("debit"), "_c": _zero("credit"), "_b": _zero("balance")}
    rows = ledger.select("statement_id", "row_idx", *[v.alias(k) for k, v in bucket.items()], reference_key(F.col("ref_number")).alias("_ref"), words_key(F.col("description")).alias("_words"))
    here = Window.partitionBy("statement_id", F.expr(f"row_idx div {block}"), *bucket).orderBy("row_idx")
    again = F.lag(F.struct("_ref", "_words")).over(here) == F.struct("_ref", "_words")
    rows = rows.withColumn("_again", again).where(~F.coalesce("_again", F.lit(False))).drop("_again")

    columns = ["statement_id", *bucket, "row_idx", "_ref", "_words"]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = itertools.chain.from_iterable(zip(*[b[c].to_pylist() for c in columns]) for b in batches)
        for key, own in itertools.groupby(stream, key=lambda r: r[:5]):
            kept, first = Bucket(), None
            for *_, at, ref, text in own:
                first = at if first is None else first
                kept.add(at, ref, text)
            n = len(kept.rows)
            yield pa.record_batch([pa.array([key[0]] * n, pa.int64()), pa.array([r[0] for r in kept.rows], pa.int64()), pa.array([first] * n, pa.int64()), pa.array(range(n), pa.int64())], names=["statement_id", "kept_row", "_first", "_place"])

    sorted_rows = rows.repartition("statement_id", *bucket).sortWithinPartitions("statement_id", *bucket, "row_idx")
    kept = sorted_rows.mapInArrow(keep, "statement_id long, kept_row long, _first long, _place long")
    numbered = renumber(kept, by=("_first", "_place")).select("statement_id", "kept_row", "row_idx")
    return ledger.withColumnRenamed("row_idx", "kept_row").join(numbered, ["statement_id", "kept_row"])


def _islands(rows: DataFrame) -> DataFrame:
    """rows with island: runs of cells of MATCH_UNITS + 1 units of balance that are all in use; balances of two islands can't match."""
    cells = rows.select("statement_id", F.floor(F.col("_b") / (MATCH_UNITS + 1)).cast("long").alias("cell")).distinct()
    numbered = renumber(cells, by=("cell",))
    islands = numbered.select("statement_id", "cell", (F.col("cell") - F.col("row_idx")).alias("island"))
    return rows.withColumn("cell", F.floor(F.col("_b") / (MATCH_UNITS + 1)).cast("long")).join(islands, ["statement_id", "cell"]).drop("cell")


class Pool:
    """Unmatched rows of one date, by balance; each balance holds its rows in order."""

    def __init__(self):
        self.balances: list[int] = []
        self.rows: dict[int, deque[int]] = {}

    def add(self, balance: int, at: int) -> None:
        if balance not in self.rows:
            bisect.insort(self.balances, balance)
            self.rows[balance] = deque()
        self.rows[balance].append(at)

    def nearest(self, balance: int) -> tuple[int, int, int] | None:
        """(distance, row, balance) of the nearest row, the first of those as near."""
        i = bisect.bisect_left(self.balances, balance)
        found = [(abs(b - balance), self.rows[b][0], b) for b in self.balances[max(0, i - 1) : i + 1]]
        return min(found, default=None)

    def take(self, balance: int) -> None:
        self.rows[balance].popleft()
        if not self.rows[balance]:
            del self.rows[balance]
            del self.balances[bisect.bisect_left(self.balances, balance)]


def match_rows(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """statement_id, row_idx, matched (row_idx of the secondary row): each primary row's match, one to one.

    In statement order, a primary row takes the free secondary row of its date (or where one has no date) whose balance is
    nearest, at most MATCH_UNITS away, the first of those as near. Missing balances are zero. Since matches need near
    balances, rows are dealt by statement, islands of balances and date; an island with a row without a date isn't split by
    dates. A task holds the free secondary rows of one such group.
    """
    plain_unions(primary.sparkSession)
    side = lambda df, n: df.select("statement_id", "row_idx", F.coalesce(scanned_date(F.col("date")), F.trim(_text("date"))).alias("_day"), _zero("balance").alias("_b"), F.lit(n).alias("_side"))
    rows = written(_islands(side(secondary, 0).unionByName(side(primary, 1))), "islands")
    undated = rows.where("_day = ''").select("statement_id", "island").distinct().withColumn("_mixed", F.lit(True))
    rows = rows.join(undated, ["statement_id", "island"], "left")
    rows = rows.withColumn("_group", F.when(F.col("_mixed"), "").otherwise(F.col("_day")))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["statement_id", "island", "_group", "_side", "row_idx", "_day", "_b"]
        stream = itertools.chain.from_iterable(zip(*[b[c].to_pylist() for c in columns]) for b in batches)
        for key, own in itertools.groupby(stream, key=lambda r: r[:3]):
            pools: dict[str, Pool] = {}
            found = []
            for *_, primary_row, at, day, balance in own:
                if not primary_row:
                    pools.setdefault(day, Pool()).add(balance, at)
                    continue
                open_to = [pools[d] for d in ({day, ""} if day else pools) if d in pools]
                best = min(((*x, i) for i, p in enumerate(open_to) if (x := p.nearest(balance))), default=None)
                if best and best[0] <= MATCH_UNITS:
                    open_to[best[3]].take(best[2])
                    found.append((key[0], at, best[1]))
            for i in range(0, len(found), 4096):
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found[i : i + 4096])], names=["statement_id", "row_idx", "matched"])

    dealt = rows.repartition("statement_id", "island", "_group").sortWithinPartitions("statement_id", "island", "_group", "_side", "row_idx")
    return dealt.mapInArrow(match, "statement_id long, row_idx long, matched long")


def _worth(r: dict, before: int | None) -> int:
    """What speaks for a row, given the balance before it."""
    text, ref = len((r["description"] or "").strip()), len((r["ref_number"] or "").strip())
    debit, credit = abs(r["debit"] or 0), abs(r["credit"] or 0)
    worth = min(26, text // 3) + (min(8, ref // 3 + 2) if ref else 0)
    worth += 24 if (debit > 0) != (credit > 0) else -14 if debit else -30
    if before is not None and r["balance"] is not None:
        worth += max(-30, 16 - (2 * abs(before + credit - debit - r["balance"]) + 25) // 50)
    return worth


def merge_extractions(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """The rows of two extractions of the same statements: statement_id, row_idx (anew), from_secondary, and the ledger's columns.

    Each primary row or its match stays, whichever tells more and fits the balance before it better (the primary one if
    equal); then the secondary rows without a match follow. A row whose date, amounts and balance an earlier one had is left
    out. A statement that only one extraction has stays as it is there.

    Every choice depends on the one before, so a statement is streamed through one task, which remembers the last balance and
    those keys that occur more than once.
    """
    primary, secondary = written(primary, "primary"), written(secondary, "secondary")  # each is read about ten times
    both = lambda a, b: a.join(b.select("statement_id").distinct(), "statement_id", "left_semi")
    known = written(match_rows(both(primary, secondary), both(secondary, primary)), "matches")
    day = F.coalesce(scanned_date(F.col("date")), F.trim(_text("date")))
    key = F.concat_ws("|", F.col("statement_id"), day, _zero("debit"), _zero("credit"), _zero("balance"))
    shape = lambda df, n: df.select("statement_id", "row_idx", *_COLUMNS, key.alias("_key"), F.lit(n).alias("_side"))
    mine, theirs = shape(primary, 0), shape(secondary, 1)
    often = mine.select("_key").unionByName(theirs.select("_key")).groupBy("_key").agg((F.count(F.lit(1)) > 1).alias("_often"))
    packed = lambda df: df.join(often, "_key", "left").withColumn("_row", F.struct("row_idx", *_COLUMNS, F.when(F.col("_often"), F.col("_key")).alias("key")))
    mine, theirs = packed(mine), packed(theirs)
    single = lambda a, b: a.select("statement_id").distinct().join(b.select("statement_id").distinct(), "statement_id", "left_anti").withColumn("_single", F.lit(True))
    alone = single(primary, secondary).unionByName(single(secondary, primary))
    pairs = mine.join(known, ["statement_id", "row_idx"], "left").join(theirs.select("statement_id", F.col("row_idx").alias("matched"), F.col("_row").alias("_other")), ["statement_id", "matched"], "left")
    left_over = theirs.join(known.select("statement_id", F.col("matched").alias("row_idx")), ["statement_id", "row_idx"], "left_anti")
    stream = pairs.select("statement_id", "_side", "row_idx", "_row", "_other").unionByName(left_over.select("statement_id", "_side", "row_idx", "_row", F.lit(None).cast(pairs.schema["_other"].dataType).alias("_other")))
    stream = stream.join(alone, "statement_id", "left")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for i in range(0, len(b), 1024) for r in b.slice(i, 1024).to_pylist())
        for statement, own in itertools.groupby(rows, key=lambda r: r["statement_id"]):
            before, seen, n, out = None, set(), 0, []
            for r in own:
                row, other = r["_row"], r["_other"]
                other_better = other is not None and _worth(other, before) > _worth(row, before)
                chosen = other if other_better else row
                if not r["_single"]:
                    if chosen["key"] in seen:
                        continue
                    if chosen["key"] is not None:
                        seen.add(chosen["key"])
                before = before if chosen["balance"] is None else chosen["balance"]
                out.append({"statement_id": statement, "row_idx": n, "from_secondary": other_better or r["_side"] == 1, **{c: chosen[c] for c in _COLUMNS}})
                n += 1
                if len(out) == 4096:
                    yield pa.RecordBatch.from_pylist(out, schema=shape_out)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=shape_out)

    text, number = pa.string(), pa.int64()
    kinds = {"statement_id": number, "row_idx": number, "from_secondary": pa.bool_(), "date": text, "description": text, "ref_number": text, "debit": number, "credit": number, "balance": number}
    shape_out = pa.schema(list(kinds.items()))
    dealt = stream.repartition("statement_id").sortWithinPartitions("statement_id", "_side", "row_idx")
    return dealt.mapInArrow(choose, f"statement_id long, row_idx long, from_secondary boolean, {LEDGER}")
