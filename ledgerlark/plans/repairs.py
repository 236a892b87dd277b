"""Named queries of balance repairs, with their SQL for DuckDB: recurrences are recursive there, row by row.

The derived ledger drifts too little, so the queries first spoil it by rules that both dialects share.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.operators import folds, repair
from ledgerlark.sources.ledger import ledger, ledger_sql

from .queries import ORACLE_SQL, QUERIES


def add_spoilt(name: str, spoil: list[str], build, sql: str, kind: str = "orders", views: tuple[str, ...] = ()) -> None:
    """As queries.add, over a ledger of the columns in spoil, with SQL that may be recursive (empty: none)."""
    QUERIES[name] = lambda spark, sf_dir: build(ledger(spark, sf_dir, kind).selectExpr(*spoil))
    text = ", ".join(spoil)
    if sql:
        ORACLE_SQL[name] = f"WITH RECURSIVE plain AS ({ledger_sql(kind, 'varchar')}), ledger AS MATERIALIZED (SELECT {text} FROM plain){''.join(f', {v}' for v in views)} {sql}"


#: Balances that drift by 0 to 12 units in runs, by one unit often, and are missing now and then.
DRIFTING = [
    "statement_id", "row_idx", "debit", "CASE WHEN row_idx % 29 = 3 THEN NULL ELSE credit END AS credit",
    "CASE WHEN row_idx % 53 = 7 THEN NULL ELSE balance + (row_idx % 17) * (row_idx % 5) % 13 END AS balance",
]
ROUNDED = [*DRIFTING[:4], "CASE WHEN row_idx % 53 = 7 THEN NULL ELSE balance + CASE WHEN row_idx % 9 IN (2, 3, 4, 7) THEN 1 ELSE 0 END END AS balance"]

_DRIFT = """walk AS (
  SELECT statement_id, row_idx, balance, balance AS corrected_balance FROM ledger WHERE row_idx = 0
  UNION ALL
  SELECT r.statement_id, r.row_idx, r.balance, CASE WHEN abs(r.balance - (w.corrected_balance + coalesce(r.credit, 0) - r.debit)) <= 10
    THEN w.corrected_balance + coalesce(r.credit, 0) - r.debit ELSE r.balance END
  FROM walk w JOIN ledger r ON r.statement_id = w.statement_id AND r.row_idx = w.row_idx + 1)"""
add_spoilt(
    "drift_correction",
    DRIFTING,
    lambda df: folds.correct_drift(df).select("statement_id", "row_idx", "balance", "corrected_balance", "is_corrected"),
    "SELECT *, coalesce(corrected_balance <> balance, false) AS is_corrected FROM walk",
    views=(_DRIFT,),
)
_EXPORT = """walk AS (
  SELECT statement_id, row_idx, coalesce(balance, 0) AS repaired_balance, CAST(0 AS BIGINT) AS off FROM ledger WHERE row_idx = 0
  UNION ALL
  SELECT statement_id, row_idx, CASE WHEN abs(expected - stated) <= 1 THEN expected ELSE stated END, expected - stated FROM (
    SELECT r.statement_id, r.row_idx, w.repaired_balance + coalesce(r.credit, 0) - r.debit AS expected, coalesce(r.balance, 0) AS stated
    FROM walk w JOIN ledger r ON r.statement_id = w.statement_id AND r.row_idx = w.row_idx + 1)),
issues AS (SELECT statement_id, row_idx, repaired_balance, CASE WHEN abs(off) = 1 THEN 'balance_minor_rounding_fix' WHEN off <> 0 THEN 'balance_major_mismatch' END AS issue,
  nullif(off, 0) AS issue_difference FROM walk)"""
add_spoilt(
    "export_repair",
    ROUNDED,
    lambda df: folds.repair_export(df).select("statement_id", "row_idx", "repaired_balance", "issue", "issue_difference"),
    "SELECT * FROM issues",
    views=(_EXPORT,),
)
add_spoilt(
    "export_repair_summary",
    ROUNDED,
    lambda df: folds.repair_summary(folds.repair_export(df)),
    """SELECT *, mismatch_ratio <= 0.2 AS is_valid FROM (
       SELECT statement_id, count(issue) AS mismatches, count(*) FILTER (issue = 'balance_minor_rounding_fix') AS minor_fixes,
         count(*) FILTER (issue = 'balance_major_mismatch') AS major_mismatches, count(issue)::DOUBLE / greatest(1, count(*) - 1) AS mismatch_ratio
       FROM issues GROUP BY statement_id)""",
    views=(_EXPORT,),
)

#: Statements in either order, some without dates, with amounts on the wrong side, slipped decimal points, wrong digits and missing values.
_REVERSED = "CASE WHEN statement_id % 3 = 0 THEN count(*) OVER (PARTITION BY statement_id) - 1 - row_idx ELSE row_idx END AS row_idx"
_WRONG = "row_idx % 6 = 1 OR row_idx % 11 = 0"
_SLIP = "CASE WHEN row_idx % 8 = 3 THEN 1000 WHEN row_idx % 13 = 4 THEN 100 ELSE 1 END"
_NOISE = "CASE WHEN row_idx % 7 = 2 THEN 3000 ELSE 0 END"
_AMOUNTS = [
    f"CAST(floor(CASE WHEN {_WRONG} THEN credit ELSE debit END / {_SLIP}) AS BIGINT) + CASE WHEN debit > 5000 THEN {_NOISE} ELSE 0 END AS debit",
    f"CAST(floor(CASE WHEN {_WRONG} THEN debit ELSE credit END / {_SLIP}) AS BIGINT) AS credit",
]
_DATED = "CASE WHEN statement_id % 4 = 1 THEN NULL ELSE date END AS date"
_MISSING = "CASE WHEN row_idx % 47 = 5 THEN NULL ELSE balance END AS balance"
MIXED = ["statement_id", _REVERSED, "description", _DATED, *_AMOUNTS, _MISSING]
#: The same in statement order.
ORDERED = ["statement_id", "row_idx", "description", _DATED, *_AMOUNTS, _MISSING]

_AROUND = """around AS (SELECT *, lag(balance) OVER w AS before, lead(balance) OVER w AS after, try_cast(date AS DATE) AS day, lag(try_cast(date AS DATE)) OVER w AS day_before,
  count(*) OVER (PARTITION BY statement_id) AS n_rows FROM ledger WINDOW w AS (PARTITION BY statement_id ORDER BY row_idx))"""
_WAYS = """ways AS (SELECT statement_id, CASE WHEN up >= 2 AND up >= 2 * down THEN 'forward' WHEN down >= 2 AND down >= 2 * up THEN 'reverse' WHEN n_ahead < 2 AND n_back < 2 THEN 'forward'
    WHEN n_ahead = 0 THEN 'reverse' WHEN n_back > 0 AND back < ahead THEN 'reverse' ELSE 'forward' END AS direction FROM (
  SELECT statement_id, count(*) FILTER (day > day_before) AS up, count(*) FILTER (day < day_before) AS down, sum(abs(before + credit - debit - balance)) AS ahead,
    count(before + balance) AS n_ahead, sum(abs(after + credit - debit - balance)) AS back, count(after + balance) AS n_back FROM around GROUP BY statement_id)),
near AS (SELECT a.*, direction, CASE direction WHEN 'forward' THEN before ELSE after END AS near, row_idx = CASE direction WHEN 'forward' THEN 0 ELSE n_rows - 1 END AS edge
  FROM around a JOIN ways USING (statement_id))"""
_HINTS = " OR ".join("contains(words, '{}')".format(h) for h in repair.CREDIT_HINTS), " OR ".join("contains(words, '{}')".format(h) for h in repair.DEBIT_HINTS)
_SIDES = f"""sides AS (SELECT *, CASE WHEN edge THEN n_rows > 1 AND coalesce((is_credit AND NOT is_debit AND debit > 0 AND credit = 0) OR (is_debit AND NOT is_credit AND credit > 0 AND debit = 0), false)
    ELSE coalesce((debit > 0) <> (credit > 0) AND stated - swapped >= 2 AND (swapped <= greatest(2, floor(greatest(debit, credit) * 0.002::DOUBLE + 0.5)) OR swapped <= floor(stated * 0.2::DOUBLE + 0.5)), false) END AS is_swapped
  FROM (SELECT *, {_HINTS[0]} AS is_credit, {_HINTS[1]} AS is_debit FROM (
    SELECT *, abs(near + credit - debit - balance) AS stated, abs(near + debit - credit - balance) AS swapped,
      concat(' ', trim(regexp_replace(lower(coalesce(description, '')), '[^a-z0-9]+', ' ', 'g')), ' ') AS words FROM near)))"""
add_spoilt(
    "balance_direction",
    MIXED,
    lambda df: repair.direction(df).select("statement_id", "direction"),
    "SELECT statement_id, direction FROM ways",
    views=(_AROUND, _WAYS),
)
add_spoilt(
    "corrected_sides",
    MIXED,
    lambda df: repair.correct_sides(df).select("statement_id", "row_idx", "debit", "credit", "direction", "is_swapped"),
    """SELECT statement_id, row_idx, CASE WHEN is_swapped THEN credit ELSE debit END AS debit, CASE WHEN is_swapped THEN debit ELSE credit END AS credit, direction, is_swapped FROM sides""",
    views=(_AROUND, _WAYS, _SIDES),
)


def _harmonized(source: str, target: str) -> str:
    """One pass over (debit, credit) of source: the first of the nearest candidates, if it is near enough."""
    scaled = []
    for k in repair.SCALES:
        d, c = f"CAST(floor(debit * {k}::DOUBLE + 0.5) AS BIGINT)", f"CAST(floor(credit * {k}::DOUBLE + 0.5) AS BIGINT)"
        scaled += [f"CASE WHEN debit > 0 AND credit = 0 THEN [{d}, 0] WHEN credit > 0 AND debit = 0 THEN [0, {c}] END", f"CASE WHEN debit > 0 AND credit = 0 THEN [0, {d}] WHEN credit > 0 AND debit = 0 THEN [{c}, 0] END"]
    ratio = "(moved::DOUBLE / nullif(greatest(debit, credit), 0))"
    last = f"CASE WHEN (greatest(debit, credit) >= 100000 AND ({ratio} >= 8 OR {ratio} <= 0.125::DOUBLE)) OR {ratio} BETWEEN 0.4::DOUBLE AND 2.5::DOUBLE THEN CASE WHEN step > 0 THEN [0, moved] ELSE [moved, 0] END END"
    pairs = f"[[debit, credit], [credit, debit], {', '.join(scaled)}, {last}]"
    passed = "SELECT * EXCLUDE (debit, credit, step, moved, offs, pairs, best, fits), CASE WHEN fits THEN pairs[best][1] ELSE debit END AS debit, CASE WHEN fits THEN pairs[best][2] ELSE credit END AS credit"
    fits = """coalesce(step <> 0 AND offs[best] + 4 < offs[1] AND (offs[best] <= greatest(2, floor(greatest(debit, credit, moved) * 0.002::DOUBLE + 0.5))
      OR offs[best] <= floor(offs[1] * 0.15::DOUBLE + 0.5)), false)"""
    steps = f"SELECT *, {pairs} AS pairs FROM (SELECT *, balance - near AS step, abs(balance - near) AS moved FROM {source})"
    offs = f"SELECT *, list_transform(pairs, lambda p : abs(near + p[2] - p[1] - balance)) AS offs FROM ({steps})"
    return f"{target} AS ({passed} FROM (SELECT *, {fits} AS fits FROM (SELECT *, list_position(offs, list_min(offs)) AS best FROM ({offs}))))"


add_spoilt(
    "harmonized_amounts",
    MIXED,
    lambda df: repair.harmonize(df).select("statement_id", "row_idx", "debit", "credit", "is_harmonized"),
    """SELECT s.statement_id, s.row_idx, s.debit, s.credit, s.debit <> l.debit OR s.credit <> l.credit AS is_harmonized
       FROM second s JOIN ledger l ON s.statement_id = l.statement_id AND s.row_idx = l.row_idx""",
    views=(_AROUND, _WAYS, _harmonized("near", "first"), _harmonized("first", "second")),
)


def _repaired(x: str) -> str:
    """The edit of amount x nearest to the step's size ``moved``."""
    digits = f"lpad(CAST({x} AS VARCHAR), CAST(greatest(length(CAST({x} AS VARCHAR)), 3) AS INT), '0')"
    edits = f"flatten(list_transform(range(1, length({digits}) + 1), lambda place : list_transform(range(10), lambda digit : {x} + (digit - CAST(substr({digits}, place, 1) AS BIGINT)) * CAST(pow(10, length({digits}) - place) AS BIGINT))))"
    scaled = ", ".join([f"{x} * {k}" for k in (10, 100, 1000)] + [f"CAST(floor({x} / {k}::DOUBLE + 0.5) AS BIGINT)" for k in (10, 100, 1000)])
    every = f"list_concat([{x}], list_filter(list_concat([{scaled}], {edits}), lambda v : v > 0))"
    best = f"{every}[list_position(list_transform({every}, lambda v : abs(v - moved)), list_min(list_transform({every}, lambda v : abs(v - moved))))]"
    return f"CASE WHEN {x} > 0 AND moved > 0 AND abs({best} - moved) <= greatest(200, moved * 0.05::DOUBLE) THEN {best} ELSE {x} END"


_SUPPORTED = f"""fixed AS (SELECT *, {_repaired("d")} AS fd, {_repaired("c")} AS fc FROM (SELECT *, abs(coalesce(debit, 0)) AS d, abs(coalesce(credit, 0)) AS c, balance - before AS step, abs(balance - before) AS moved FROM around)),
supported AS (SELECT *, CASE WHEN d > 0 AND c > 0 THEN CASE WHEN abs(fc - moved) < abs(fd - moved) OR (abs(abs(fc - moved) - abs(fd - moved)) <= 1 AND step >= 0) THEN fc ELSE fd END WHEN d > 0 THEN fd ELSE fc END AS amount FROM fixed)"""
add_spoilt(
    "locked_columns",
    ORDERED,
    lambda df: repair.lock_columns(df).select("statement_id", "row_idx", "debit", "credit"),
    """SELECT statement_id, row_idx, CASE WHEN put THEN CASE WHEN step > 0 THEN 0 ELSE amount END ELSE debit END AS debit, CASE WHEN put THEN CASE WHEN step > 0 THEN amount ELSE 0 END ELSE credit END AS credit
       FROM (SELECT *, coalesce(step <> 0 AND amount > 0, false) AS put FROM supported)""",
    views=(_AROUND, _SUPPORTED),
)
_EMPTIED = [*ORDERED[:4], *[f"CASE WHEN row_idx % 17 = 2 THEN 0 ELSE {x.rsplit(' AS ', 1)[0]} END AS {x.rsplit(' AS ', 1)[1]}" for x in _AMOUNTS], _MISSING]
add_spoilt(
    "validated_rows",
    _EMPTIED,
    lambda df: repair.validate_rows(df).select("statement_id", "row_idx", "debit", "credit", "balance_inferred", "low_confidence"),
    """SELECT statement_id, row_idx, CASE WHEN step IS NULL THEN debit WHEN put THEN CASE WHEN step > 0 THEN 0 ELSE x END ELSE d END AS debit,
         CASE WHEN step IS NULL THEN credit WHEN put THEN CASE WHEN step > 0 THEN x ELSE 0 END ELSE c END AS credit,
         put AND abs(x - moved) <= 100 AND d = 0 AND c = 0 AS balance_inferred, row_idx > 0 AND NOT coalesce(fits, false) AND NOT (put AND abs(x - moved) <= 100) AS low_confidence
       FROM (SELECT *, coalesce(NOT fits AND step <> 0 AND x > 0, false) AS put FROM (
         SELECT *, CASE WHEN d = 0 AND c = 0 THEN moved ELSE amount END AS x, abs(before + c - d - balance) <= 100 AS fits FROM supported))""",
    views=(_AROUND, _SUPPORTED),
)
_ORDER = """orders AS (SELECT statement_id, CASE WHEN any_value(n_rows) < 2 THEN 'chron' WHEN any_value(up + down) >= 2 AND any_value(n_dated) >= 3 AND any_value(up) >= ceil(any_value(up + down) * 0.6::DOUBLE) THEN 'chron'
    WHEN any_value(up + down) >= 2 AND any_value(n_dated) >= 3 AND any_value(down) >= ceil(any_value(up + down) * 0.6::DOUBLE) THEN 'reverse'
    WHEN count(*) FILTER (abs(after + debit - credit - balance) + 1 < abs(after + credit - debit - balance)) + 1 < count(*) FILTER (abs(before + debit - credit - balance) + 1 < abs(before + credit - debit - balance)) THEN 'reverse'
    ELSE 'chron' END AS row_order
  FROM around LEFT JOIN (SELECT statement_id, count(*) AS n_dated, count(*) FILTER (day > b) AS up, count(*) FILTER (day < b) AS down
    FROM (SELECT statement_id, day, lag(day) OVER (PARTITION BY statement_id ORDER BY row_idx) AS b FROM around WHERE day IS NOT NULL) GROUP BY statement_id) USING (statement_id) GROUP BY statement_id),
settled AS (SELECT *, CASE WHEN move THEN CASE WHEN step > 0 THEN 0 ELSE greatest(debit, credit) END ELSE debit END AS d, CASE WHEN move THEN CASE WHEN step > 0 THEN greatest(debit, credit) ELSE 0 END ELSE credit END AS c
  FROM (SELECT *, coalesce((debit > 0) <> (credit > 0) AND swapped + 1 < stated AND stated - swapped >= 2 AND swapped <= greatest(2, greatest(debit, credit) * 0.002::DOUBLE)
      AND ((step > 0 AND debit > 0) OR (step < 0 AND credit > 0)), false) AS move
    FROM (SELECT *, balance - near AS step, abs(near + credit - debit - balance) AS stated, abs(near + debit - credit - balance) AS swapped
      FROM (SELECT *, CASE row_order WHEN 'reverse' THEN after ELSE before END AS near FROM around JOIN orders USING (statement_id)))))"""
_MIXED_EMPTIED = [*MIXED[:4], *_EMPTIED[4:]]
add_spoilt(
    "settled_sides",
    MIXED,
    lambda df: repair.settle_sides(df).select("statement_id", "row_idx", "row_order", "debit", "credit"),
    "SELECT statement_id, row_idx, row_order, d AS debit, c AS credit FROM settled",
    views=(_AROUND, _ORDER),
)
add_spoilt(
    "filled_sides",
    _MIXED_EMPTIED,
    lambda df: repair.settle_sides(df, fill=True).select("statement_id", "row_idx", "debit", "credit"),
    """SELECT statement_id, row_idx, CASE WHEN fill THEN CASE WHEN step > 0 THEN 0 ELSE x END ELSE d END AS debit, CASE WHEN fill THEN CASE WHEN step > 0 THEN x ELSE 0 END ELSE c END AS credit
       FROM (SELECT *, CASE WHEN d = 0 AND c = 0 THEN abs(step) ELSE greatest(d, c) END AS x, coalesce(step <> 0 AND ((d = 0 AND c = 0) OR (d > 0 AND c > 0)), false) AS fill FROM settled)""",
    views=(_AROUND, _ORDER),
)
_HEADERS = "SELECT statement_id, CASE WHEN statement_id % 5 = 1 THEN NULL ELSE 100000 + statement_id % 4 END AS opening_balance, CASE WHEN statement_id % 3 = 2 THEN NULL ELSE {last} + statement_id % 4 - CASE WHEN statement_id % 7 = 3 THEN 1 ELSE 0 END END AS closing_balance"
add_spoilt(
    "offset_balances",
    ["statement_id", "row_idx", "debit", "credit", "balance"],
    lambda df: repair.apply_offsets(df, df.groupBy("statement_id").agg(F.max_by("balance", "row_idx").alias("last")).selectExpr(*_HEADERS.format(last="last").removeprefix("SELECT ").split(", "))),
    f"""SELECT l.statement_id, l.row_idx, l.debit, l.credit, balance + coalesce(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN abs(a - b) <= 1 AND abs(a) <= 10 THEN CAST(floor((a + b) / 2::DOUBLE + 0.5) AS BIGINT) END
         WHEN abs(coalesce(a, b)) <= 10 THEN coalesce(a, b) END, 0) AS balance
       FROM ledger l JOIN (SELECT statement_id, opening_balance - (first.balance - first.credit + first.debit) AS a, closing_balance - last AS b FROM (
         {_HEADERS.format(last="last")}, * EXCLUDE (statement_id) FROM (SELECT statement_id, arg_min(ledger, row_idx) AS first, arg_max(balance, row_idx) AS last FROM ledger GROUP BY statement_id))) h USING (statement_id)""",
)
