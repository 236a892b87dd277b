"""The named query of quotas, over events derived from the event table, with recursive SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.operators import entitlements
from ledgerlark.operators.quota import quota_states

from .queries import ORACLE_SQL, QUERIES

_ZONES = [("+05:30", 330), ("-08:00", -480), (None, 0)]
_EVENTS = f"""event_id AS seq, user_id % 40 AS user_id, ts AS at, CASE WHEN event_id % 10 < 3 THEN 'check' WHEN event_id % 10 < 7 THEN 'use' WHEN event_id % 10 = 7 THEN 'other' ELSE 'payment' END AS kind,
  CASE event_id % 3 {' '.join(f"WHEN {i} THEN {repr(z) if z else 'NULL'}" for i, (z, _) in enumerate(_ZONES))} END AS timezone, CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_id % 5 - 1 END AS n,
  CASE WHEN event_id % 23 = 0 THEN NULL ELSE event_id % 37 END AS order_id, CASE event_id % 4 WHEN 0 THEN 'yearly_pro' WHEN 1 THEN 'monthly' WHEN 2 THEN 'pack' ELSE NULL END AS plan_id,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 9 - 2 END AS pages"""


def quota_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quota events of forty users; each user's are repeated once in part, as a replay would."""
    rows = spark.sql(f"SELECT {_EVENTS} FROM {{events}}", events=spark.read.parquet(f"{sf_dir}/events.parquet"))
    return rows.unionByName(rows.where("seq % 6 = 1"))


QUERIES["quota_states"] = lambda spark, sf_dir: quota_states(quota_events(spark, sf_dir))
ORACLE_SQL["quota_states"] = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS i,
    CAST(moment + to_minutes(CASE timezone {' '.join(f"WHEN '{z}' THEN {m}" for z, m in _ZONES if z)} ELSE 0 END) AS DATE) AS day FROM (SELECT {_EVENTS.replace(' AS at,', ' AS moment,')} FROM events)),
walk AS (
  SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS seq, '' AS kind, false AS known, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS lim, CAST(NULL AS DATE) AS last, CAST(NULL AS BOOLEAN) AS reset, CAST(NULL AS BOOLEAN) AS done,
    CAST(NULL AS BIGINT) AS added, CAST(NULL AS VARCHAR) AS plan, CAST([] AS BIGINT[]) AS orders FROM e WHERE i = 1
  UNION ALL
  SELECT user_id, i, seq, kind, known OR c OR p,
    CASE WHEN c AND (NOT known OR day > last) THEN 0 WHEN u AND known THEN used + greatest(coalesce(n, 1), 1) WHEN p THEN CASE WHEN known THEN least(used, lim + extra) ELSE 0 END ELSE used END,
    CASE WHEN c AND NOT known THEN 5 WHEN p THEN lim + extra ELSE lim END, CASE WHEN c THEN CASE WHEN NOT known OR day > last THEN day ELSE last END WHEN p AND NOT known THEN CAST(moment AS DATE) ELSE last END,
    CASE WHEN c THEN known AND day > last END, CASE WHEN kind = 'payment' AND order_id IS NOT NULL THEN NOT p END, CASE WHEN p THEN extra WHEN kind = 'payment' AND order_id IS NOT NULL THEN 0 END,
    CASE WHEN p THEN plan_id ELSE plan END, CASE WHEN p THEN list_append(orders, order_id) ELSE orders END
  FROM (SELECT w.user_id, e.i, e.seq, e.kind, known, used, lim, last, plan, orders, moment, day, n, order_id, plan_id, e.kind = 'check' AS c, e.kind = 'use' AS u, e.kind = 'payment' AND order_id IS NOT NULL AND NOT list_contains(orders, order_id) AS p,
      CAST(greatest(coalesce(pages, 0), 0) AS BIGINT) AS extra FROM walk w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1))
SELECT user_id, seq, kind, known AS is_known, CASE WHEN known THEN used END AS pages_used, CASE WHEN known THEN lim END AS pages_limit, last AS last_reset, reset AS needs_reset, done AS already_processed, added AS pages_added,
  CASE WHEN known THEN CASE WHEN plan LIKE 'yearly%' THEN 'business' WHEN plan LIKE 'monthly%' THEN 'daily' ELSE 'free' END END AS tier, CASE WHEN known THEN plan END AS plan_id FROM walk WHERE i > 0"""


_NAMES = [*entitlements.RANKS, "business", " PRO ", "basic", "paid", "Legacy", ""]
_PLAN = "CASE c_custkey % 19 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
_SUBSCRIPTIONS = f"""c_custkey AS user_id, {_PLAN} AS plan_type, CASE c_custkey % 5 WHEN 0 THEN 'business' WHEN 1 THEN 'pro' WHEN 2 THEN '' END AS tier,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 999999 ELSE CAST(floor(abs(c_acctbal)) AS BIGINT) * (c_custkey % 3) END AS pages_limit, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 6000 END AS pages_used"""
_ORDERS = f"o_custkey AS user_id, {_PLAN.replace('c_custkey', 'o_orderkey')} AS plan_id, CASE o_orderstatus WHEN 'O' THEN 'paid' ELSE 'created' END AS status"
_PACK = "CASE " + " ".join(f"WHEN {{0}} >= {n} THEN '{p}'" for p, n in sorted(entitlements.PAGES.items(), key=lambda x: -x[1])) + " END"


def _effective(name: str, limit: str) -> str:
    pack = _PACK.format(limit)
    return f"""CASE WHEN {name} = 'unlimited' AND {limit} >= 900000 THEN 'unlimited' WHEN {name} IN ('free', 'unlimited', 'business', 'paid') THEN coalesce({pack}, 'free')
      WHEN {name} = 'pro' THEN coalesce({pack}, 'per_page_pack_pro') WHEN {name} = 'basic' THEN coalesce({pack}, 'per_page_pack_basic') ELSE {name} END"""


def _subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT {_SUBSCRIPTIONS} FROM {{customer}}", customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def plan_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _subscriptions(spark, sf_dir)
    return rows.select("user_id", *[v.alias(k) for k, v in entitlements.features(F.col("plan_type"), F.col("pages_limit")).items()], F.array_join(entitlements.export_formats(F.col("plan_type")), ",").alias("formats"))


def settled_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.sql(f"SELECT {_ORDERS} FROM {{orders}}", orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return entitlements.settle_orders(_subscriptions(spark, sf_dir), orders).select("user_id", "needs_repair", "settled_plan", "settled_limit", "settled_used", "settled_tier")


QUERIES |= {"plan_features": plan_features, "settled_subscriptions": settled_subscriptions}
_RANK = "CASE {0} " + " ".join(f"WHEN '{p}' THEN {r}" for p, r in entitlements.RANKS.items()) + " ELSE 0 END"
ORACLE_SQL["plan_features"] = f"""SELECT user_id, p AS effective_plan, p = 'unlimited' OR starts_with(p, 'per_page_pack_') AS is_paid, p = 'unlimited' OR starts_with(p, 'per_page_pack_') AS mt940,
    p IN ('unlimited', 'per_page_pack_basic', 'per_page_pack_pro', 'per_page_pack_enterprise') AS tally_xml, p IN ('unlimited', 'per_page_pack_basic', 'per_page_pack_pro', 'per_page_pack_enterprise') AS ratio_dashboard,
    p IN ('unlimited', 'per_page_pack_pro', 'per_page_pack_enterprise') AS accounting, CASE WHEN p IN ('unlimited', 'per_page_pack_enterprise') THEN 'advanced' WHEN p = 'per_page_pack_pro' THEN 'basic' ELSE 'none' END AS edit_detector,
    CASE WHEN name = 'per_page_pack_starter' THEN 'xlsx,csv,json,mt940' WHEN name IN ('per_page_pack_basic', 'per_page_pack_pro') THEN 'xlsx,csv,json,mt940,foir_report'
      WHEN name IN ('per_page_pack_enterprise', 'unlimited') THEN 'xlsx,csv,json,mt940,foir_report,fraud_report' ELSE 'xlsx,csv' END AS formats
  FROM (SELECT *, {_effective("name", "pages_limit")} AS p FROM (SELECT *, trim(lower(coalesce(plan_type, 'free'))) AS name FROM (SELECT {_SUBSCRIPTIONS} FROM customer)))"""
ORACLE_SQL["settled_subscriptions"] = f"""WITH s AS (SELECT *, {_effective("name", "lim")} AS own FROM (SELECT user_id, coalesce(pages_limit, 0) AS lim, coalesce(pages_used, 0) AS used,
    CASE WHEN trim(lower(coalesce(plan_type, 'free'))) IN ('', 'free') THEN coalesce(nullif(trim(lower(tier)), ''), 'free') ELSE trim(lower(plan_type)) END AS name FROM (SELECT {_SUBSCRIPTIONS} FROM customer))),
  paid AS (SELECT user_id, sum(pages) AS pages, max(r) AS r, arg_max(plan, r) AS best FROM (SELECT user_id, plan, {_RANK.format("plan")} AS r, CASE plan {' '.join(f"WHEN '{p}' THEN {n}" for p, n in entitlements.PAGES.items())} END AS pages
      FROM (SELECT user_id, trim(lower(coalesce(plan_id, 'free'))) AS plan FROM (SELECT {_ORDERS} FROM orders) WHERE status = 'paid')) WHERE pages IS NOT NULL GROUP BY user_id),
  j AS (SELECT s.*, pages, best, r > {_RANK.format("own")} AS higher, coalesce(pages > lim OR r > {_RANK.format("own")} OR (own = 'free' AND best IS NOT NULL), false) AS repair FROM s LEFT JOIN paid ON paid.user_id = s.user_id)
SELECT user_id, repair AS needs_repair, CASE WHEN repair AND higher THEN best ELSE own END AS settled_plan, CAST(CASE WHEN repair THEN greatest(lim, pages) ELSE lim END AS BIGINT) AS settled_limit,
  CAST(CASE WHEN repair THEN least(used, greatest(lim, pages)) ELSE used END AS BIGINT) AS settled_used, CASE WHEN (CASE WHEN repair AND higher THEN best ELSE own END) = 'free' THEN 'free' ELSE 'business' END AS settled_tier FROM j"""
