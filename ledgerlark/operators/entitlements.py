"""What a plan allows: the plan that counts, its features and formats, and subscriptions brought in line with paid orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Plans by rank, the pages that a plan brings and from which it counts, the limit of an unlimited plan.
RANKS = {
    "free": 0, "bonus_free_basic": 0, "per_page_lite": 1, "per_page_standard": 2, "per_page_power": 3, "per_page_pack_starter": 4, "per_page_pack_basic": 5, "per_page_pack_pro": 6,
    "per_page_pack_enterprise": 7, "unlimited": 8,
}
PAGES = {
    "per_page_lite": 10, "per_page_standard": 25, "per_page_power": 50, "per_page_pack_starter": 500, "per_page_pack_basic": 1000, "per_page_pack_pro": 5000, "per_page_pack_enterprise": 11000,
}
UNLIMITED_FROM = 900_000
# Older names and the plan they stand for without a limit; formats of all plans, of packs, and by feature.
OLD_NAMES = {"free": "free", "unlimited": "free", "business": "free", "paid": "free", "pro": "per_page_pack_pro", "basic": "per_page_pack_basic"}
PACKS = ["per_page_pack_starter", "per_page_pack_basic", "per_page_pack_pro", "per_page_pack_enterprise", "unlimited"]
PLAIN_FORMATS, PACK_FORMATS, RATIO_FORMAT, FRAUD_FORMAT = ["xlsx", "csv"], ["xlsx", "csv", "json", "mt940"], "foir_report", "fraud_report"


def _name(plan: Column) -> Column:
    return F.trim(F.lower(F.coalesce(plan, F.lit("free"))))


def pack_of(limit: Column) -> Column:
    """The largest plan whose pages a limit covers; null below all and for a null limit."""
    out = F.lit(None).cast("string")
    for plan, pages in sorted(PAGES.items(), key=lambda x: x[1]):
        out = F.when(limit >= pages, plan).otherwise(out)
    return out


def effective_plan(plan: Column, limit: Column) -> Column:
    """The plan that counts: old names follow the limit, plans by the page and unknown names stay; unlimited needs a limit that large."""
    name, pack = _name(plan), pack_of(limit)
    out = F.when((name == "unlimited") & F.coalesce(limit >= UNLIMITED_FROM, F.lit(False)), "unlimited")
    for old, without in OLD_NAMES.items():
        out = out.when(name == old, F.coalesce(pack, F.lit(without)))
    return out.otherwise(name)


def rank(plan: Column) -> Column:
    """The rank of a plan's name; 0 for unknown names."""
    known = F.create_map(*[F.lit(x) for pair in RANKS.items() for x in pair])
    return F.coalesce(F.element_at(known, _name(plan)), F.lit(0))


def features(plan: Column, limit: Column) -> dict[str, Column]:
    """Columns of what the plan that counts unlocks."""
    own = effective_plan(plan, limit)
    return {
        "effective_plan": own, "is_paid": (own == "unlimited") | own.startswith("per_page_pack_"), "mt940": own.isin(PACKS), "tally_xml": own.isin(PACKS[1:]), "ratio_dashboard": own.isin(PACKS[1:]),
        "accounting": own.isin(PACKS[2:]), "edit_detector": F.when(own.isin(PACKS[3:]), "advanced").when(own == PACKS[2], "basic").otherwise("none"),
    }


def export_formats(plan: Column) -> Column:
    """The formats that a plan's name allows: plain ones, all core formats for packs, reports for larger packs."""
    name = F.coalesce(F.nullif(F.trim(F.lower(F.coalesce(plan, F.lit("")))), F.lit("")), F.lit("free"))
    both = F.array_compact(F.array(F.when(name.isin(PACKS[1:]), RATIO_FORMAT), F.when(name.isin(PACKS[3:]), FRAUD_FORMAT)))
    return F.when(name.isin(PACKS), F.concat(F.array(*map(F.lit, PACK_FORMATS)), both)).otherwise(F.array(*map(F.lit, PLAIN_FORMATS)))


def settle_orders(subscriptions: DataFrame, orders: DataFrame) -> DataFrame:
    """subscriptions with settled_plan, settled_limit, settled_used, settled_tier and needs_repair, after the paid orders of known plans.

    subscriptions: user_id, plan_type, tier (counts where the plan is free or blank), pages_limit, pages_used (null: 0). orders:
    user_id, plan_id, status. A subscription is repaired if its orders bring more pages than its limit or a higher plan, or if its own plan is free; then it has the larger
    limit, the higher plan (its own if equal), and no more used than the limit. Orders are summed by user and plan first.
    """
    name = _name(F.col("plan_id"))
    pages = F.element_at(F.create_map(*[F.lit(x) for pair in PAGES.items() for x in pair]), F.col("plan"))
    paid = orders.where("status = 'paid'").groupBy("user_id", name.alias("plan")).agg(F.count(F.lit(1)).alias("n")).withColumn("pages", pages).where("pages is not null")
    sums = paid.groupBy("user_id").agg(F.sum(F.col("n") * F.col("pages")).alias("_pages"), F.max_by("plan", rank(F.col("plan"))).alias("_best"))
    limit, used = F.coalesce("pages_limit", F.lit(0)), F.coalesce("pages_used", F.lit(0))
    known = subscriptions.join(sums, "user_id", "left").withColumn("_own", effective_plan(F.when(_name(F.col("plan_type")).isin("", "free"), F.coalesce(F.nullif(F.trim("tier"), F.lit("")), F.lit("free"))).otherwise(F.col("plan_type")), limit))
    higher = rank(F.col("_best")) > rank(F.col("_own"))
    known = known.withColumn("needs_repair", F.col("_best").isNotNull() & ((F.col("_pages") > limit) | higher | (F.col("_own") == "free")))
    settled = known.withColumns({"settled_limit": F.when(F.col("needs_repair"), F.greatest(limit, F.col("_pages"))).otherwise(limit), "settled_plan": F.when(F.col("needs_repair") & higher, F.col("_best")).otherwise(F.col("_own"))})
    out = settled.withColumns({"settled_used": F.when(F.col("needs_repair"), F.least(used, F.col("settled_limit"))).otherwise(used), "settled_tier": F.when(F.col("settled_plan") == "free", "free").otherwise("business")})
    return out.drop("_pages", "_best", "_own")
