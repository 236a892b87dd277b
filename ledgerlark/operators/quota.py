"""Page quotas: daily resets, use, and payments that count once, from the events of each user in their order.

Events: user_id, seq (long, ascending for a user; a repeated seq is a replay of the same event), at (timestamp, UTC), kind, timezone,
n (pages used), order_id, plan_id, pages. Kinds: check (reset if a new local day has begun), use, payment. Others do nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pages a day without a plan, and tiers by the beginning of a plan's name.
FREE_PAGES, TIERS, FREE_TIER = 5, [("yearly", "business"), ("monthly", "daily")], "free"
RESULT = "user_id long, seq long, kind string, is_known boolean, pages_used long, pages_limit long, last_reset date, needs_reset boolean, already_processed boolean, pages_added long, tier string, plan_id string"


def tier(plan: Column) -> Column:
    out = F.lit(FREE_TIER)
    for prefix, name in reversed(TIERS):
        out = F.when(plan.startswith(prefix), name).otherwise(out)
    return F.when(plan.isNotNull(), out).otherwise(FREE_TIER)


def local_day(at: Column, timezone: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(at, F.coalesce(timezone, F.lit("UTC"))))


def quota_states(events: DataFrame) -> DataFrame:
    """RESULT after each event: the user's quota, and what the event did.

    A user becomes known with a check (FREE_PAGES, nothing used) or a payment (its pages). A check on a later local day than
    the last reset empties what was used. The first payment of an order adds its pages and its plan, and what was used is cut to
    the limit; later ones of that order are already processed. A payment without an order id does nothing. Use before
    that counts for nothing; less than one page counts as one.

    With caps only at payments, what was used is the running sum of uses plus the least of what resets and caps allow since
    the last reset, so the state follows from running sums, minima and maxima. A user's events are sorted in one task.
    """
    rows = events.dropDuplicates(["user_id", "seq"]).select("user_id", "seq", "at", "kind", "timezone", "n", "order_id", "plan_id", "pages")
    user = Window.partitionBy("user_id").orderBy("seq")
    past, before = user.rowsBetween(Window.unboundedPreceding, 0), user.rowsBetween(Window.unboundedPreceding, -1)
    pays = (F.col("kind") == "payment") & F.col("order_id").isNotNull()
    # an order's first payment; other events are orders of their own
    order = F.when(pays, F.col("order_id").cast("string")).otherwise(F.concat(F.lit("event "), F.col("seq")))
    rows = rows.withColumn("_first", F.row_number().over(Window.partitionBy("user_id", order).orderBy("seq")) == 1).withColumn("_pays", pays & F.col("_first"))
    known = F.coalesce(F.max((F.col("kind") == "check") | F.col("_pays")).over(past), F.lit(False))
    rows = rows.withColumn("_known", known).withColumn("_before", F.coalesce(F.lag("_known").over(user), F.lit(False)))
    added = F.when(F.col("_pays"), F.greatest(F.coalesce("pages", F.lit(0)), F.lit(0))).otherwise(0).cast("long")
    used = F.when((F.col("kind") == "use") & F.col("_before"), F.greatest(F.coalesce("n", F.lit(1)), F.lit(1))).otherwise(0).cast("long")
    begins = F.col("_known") & ~F.col("_before")
    day = F.when(F.col("kind") == "check", local_day(F.col("at"), F.col("timezone"))).when(begins, F.to_date("at"))
    rows = rows.withColumns({"_added": added, "_day": day, "_sum": F.sum(used).over(past), "_free": F.when(begins & (F.col("kind") == "check"), FREE_PAGES).otherwise(0)})
    rows = rows.withColumns({"_limit": F.sum(F.col("_added") + F.col("_free")).over(past), "_last": F.max("_day").over(before)})
    rows = rows.withColumn("_reset", F.coalesce((F.col("kind") == "check") & F.col("_before") & (F.col("_day") > F.col("_last")), F.lit(False)))
    rows = rows.withColumns({"_epoch": F.sum(F.col("_reset").cast("long")).over(past), "_told": F.struct("plan_id")})
    epoch = Window.partitionBy("user_id", "_epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    cap = F.least(-F.first("_sum").over(epoch), F.coalesce(F.min(F.when(F.col("_pays"), F.col("_limit") - F.col("_sum"))).over(epoch), F.lit((1 << 63) - 1)))
    plan = F.last(F.when(F.col("_pays"), F.struct("plan_id")), ignorenulls=True).over(past)
    rows = rows.withColumns({"_used": F.col("_sum") + cap, "_plan": plan})
    whole = lambda x: F.when(F.col("_known"), x)
    return rows.select(
        "user_id", "seq", "kind", F.col("_known").alias("is_known"), whole(F.col("_used")).alias("pages_used"), whole(F.col("_limit")).alias("pages_limit"), whole(F.coalesce(F.greatest("_last", "_day"), "_last", "_day")).alias("last_reset"),
        F.when(F.col("kind") == "check", F.col("_reset")).alias("needs_reset"), F.when(pays, ~F.col("_first")).alias("already_processed"), F.when(pays, F.col("_added")).alias("pages_added"),
        whole(tier(F.col("_plan.plan_id"))).alias("tier"), whole(F.col("_plan.plan_id")).alias("plan_id"),
    )
