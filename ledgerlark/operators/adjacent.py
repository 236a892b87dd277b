"""Values of the row before, without holding a whole statement in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def previous(ledger: DataFrame, block: int = BLOCK, **values: Column) -> DataFrame:
    """Ledger rows with each value of the statement's row before, under its name (null on the first row).

    row_idx counts a statement's rows from 0 without gaps. Rows are dealt by blocks of row_idx, and the last row of each
    block is copied to the next one, so a statement of any length spreads over tasks of at most block + 1 of its rows.
    """
    own = F.expr(f"row_idx div {block}")
    homes = F.when(F.col("row_idx") % block == block - 1, F.array(own, own + 1)).otherwise(F.array(own))
    in_order = Window.partitionBy("statement_id", "_block").orderBy("row_idx")
    dealt = ledger.withColumn("_block", F.explode(homes))
    dealt = dealt.withColumns({name: F.lag(value).over(in_order) for name, value in values.items()})
    return dealt.where(F.col("_block").eqNullSafe(own)).drop("_block")


def following(ledger: DataFrame, block: int = BLOCK, **values: Column) -> DataFrame:
    """As previous, but of the statement's row after: the first row of each block is copied to the block before."""
    own = F.expr(f"row_idx div {block}")
    homes = F.when((F.col("row_idx") % block == 0) & (F.col("row_idx") > 0), F.array(own, own - 1)).otherwise(F.array(own))
    in_order = Window.partitionBy("statement_id", "_block").orderBy("row_idx")
    dealt = ledger.withColumn("_block", F.explode(homes))
    dealt = dealt.withColumns({name: F.lead(value).over(in_order) for name, value in values.items()})
    return dealt.where(F.col("_block").eqNullSafe(own)).drop("_block")


def renumber(rows: DataFrame, block: int = BLOCK, by: tuple[str, ...] = ("row_idx",), group: str = "statement_id") -> DataFrame:
    """Rows with row_idx counted anew from 0 without gaps in each group, in the order of ``by`` (nulls last).

    The last name in ``by`` is a long that counts something; rows are dealt by the others and blocks of it. A block's rows are
    numbered by themselves and start after the rows of the blocks before it; what meets in one task is a block of rows or a
    group's block counts. Rows that agree in all of ``by`` are numbered in any order.
    """
    out = [*rows.columns, *([] if "row_idx" in rows.columns else ["row_idx"])]
    keys = {f"_k{i}": F.col(c) for i, c in enumerate(by[:-1])} | {"_block": F.expr(f"{by[-1]} div {block}")}
    rows = rows.withColumns(keys)
    order = [F.asc_nulls_last(k) for k in keys]
    counts = rows.groupBy(group, *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(group).alias("_group"), *[F.col(k).alias(f"_of{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    in_order = Window.partitionBy(group, *keys).orderBy(F.asc_nulls_last(by[-1]))
    met = F.col(group).eqNullSafe(F.col("_group"))
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_of{k}"))
    numbered = rows.withColumn("_place", F.row_number().over(in_order)).join(starts, met)
    return numbered.withColumn("row_idx", F.col("_start") + F.col("_place") - 1).select(*out)
