"""Plans, features and paid orders, on hand-made rows."""

from pyspark.sql import functions as F

from ledgerlark.operators import entitlements as plans


def test_effective_plans_and_features(spark):
    cases = [("bonus_free_basic", 50), ("free", 500), ("business", 5000), ("basic", 1000), ("unlimited", 999999), ("unlimited", 60), ("pro", None), (None, None), (" Per_Page_Power ", 99999), ("odd", 500), ("free", 9)]
    df = spark.createDataFrame(cases, "plan string, lim long")
    own = plans.features(F.col("plan"), F.col("lim"))
    found = df.select(*[v.alias(k) for k, v in own.items()]).collect()
    assert [r["effective_plan"] for r in found] == ["bonus_free_basic", "per_page_pack_starter", "per_page_pack_pro", "per_page_pack_basic", "unlimited", "per_page_power", "per_page_pack_pro", "free", "per_page_power", "odd", "free"]
    assert [r["is_paid"] for r in found] == [False, True, True, True, True, False, True, False, False, False, False]
    assert [(r["mt940"], r["tally_xml"], r["accounting"], r["edit_detector"]) for r in found[1:5]] == [(True, False, False, "none"), (True, True, True, "basic"), (True, True, False, "none"), (True, True, True, "advanced")]
    formats = {r["plan"]: r["f"] for r in df.select("plan", plans.export_formats(F.col("plan")).alias("f")).collect()}
    assert formats[None] == ["xlsx", "csv"] and formats["unlimited"][-1] == "fraud_report" and formats["business"] == ["xlsx", "csv"]


def test_subscriptions_follow_paid_orders(spark):
    subscriptions = [(1, "free", None, 5, 3), (2, "per_page_pack_pro", "x", 5000, 4000), (3, "per_page_lite", None, 10, 90), (4, None, "business", 500, None), (5, "free", "", None, None)]
    orders = [(1, "per_page_lite", "paid"), (1, "per_page_lite", "paid"), (1, " PER_PAGE_STANDARD", "paid"), (1, "per_page_pack_pro", "created"), (2, "per_page_lite", "paid"), (3, "per_page_power", "paid"), (4, "per_page_lite", "paid"), (5, "odd", "paid"), (9, "per_page_lite", "paid")]
    found = plans.settle_orders(spark.createDataFrame(subscriptions, "user_id long, plan_type string, tier string, pages_limit long, pages_used long"), spark.createDataFrame(orders, "user_id long, plan_id string, status string"))
    rows = {r["user_id"]: (r["needs_repair"], r["settled_plan"], r["settled_limit"], r["settled_used"], r["settled_tier"]) for r in found.collect()}
    assert rows == {
        1: (True, "per_page_standard", 45, 3, "business"), 2: (False, "per_page_pack_pro", 5000, 4000, "business"), 3: (True, "per_page_power", 50, 50, "business"),
        4: (False, "per_page_pack_starter", 500, 0, "business"), 5: (False, "free", 0, 0, "free"),
    }
