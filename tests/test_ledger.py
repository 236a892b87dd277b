"""Ledger queries against their SQL in DuckDB, and operators on hand-made rows."""

import duckdb
import pytest

from pyspark.sql import functions as F

from ledgerlark.operators import alerts, analytics, balance, cleaning, exports, flow, statistics, underwriting
from ledgerlark.operators.adjacent import following, previous
from ledgerlark.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "statement_id long, row_idx long, date string, description string, ref_number string, debit long, credit long, balance long"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("customer", "events", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    expected = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    theirs = sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in expected.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def rows(spark, *values):
    return spark.createDataFrame([(1, i, "2024-01-01", "x", "r", *v) for i, v in enumerate(values)], SCHEMA)


def test_perfect_chain_has_no_mismatch(spark):
    summary = balance.reconcile_summary(balance.reconcile(rows(spark, (0, 0, 10000), (2500, 0, 7500), (0, 500, 8000)))).first()
    assert (summary["mismatches"], summary["integrity"]) == (0, 100)


def test_one_unit_is_tolerated_by_reconcile_but_minor_in_audit(spark):
    df = rows(spark, (0, 0, 10000), (0, 500, 10501))
    assert balance.reconcile(df).where("balance_mismatch").count() == 0
    assert balance.audit(df).first()["minor"] == 1


def test_severity_steps(spark):
    df = rows(spark, (0, 0, 0), (0, 0, 50), (0, 0, 15050), (0, 0, 165050), (0, 0, 1665050))
    assert [r["severity"] for r in balance.reconcile(df).orderBy("row_idx").collect()] == [None, "low", "medium", "high", "critical"]


def test_duplicates_need_a_reference(spark):
    df = rows(spark, (5, 0, 0), (5, 0, 0), (5, 0, 0)).withColumn("ref_number", __import__("pyspark").sql.functions.expr("if(row_idx = 2, '', 'r')"))
    assert [(r["is_duplicate"], r["duplicate_group"]) for r in analytics.duplicates(df).orderBy("row_idx").collect()] == [(True, 1), (True, 1), (False, None)]


def test_last_risk_type_is_the_flag(spark):
    df = rows(spark, (5, 0, 0)).selectExpr("* except (description)", "'Casino bounce' as description")
    assert sorted((r["risk_type"], r["risk_flag"]) for r in analytics.high_risk(df).collect()) == [("bouncedPayment", "bouncedPayment"), ("gambling", "bouncedPayment")]


def test_confidence_of_a_row_without_date_and_amount(spark):
    df = rows(spark, (0, 0, 0)).selectExpr("* except (date)", "'' as date", "false as balance_mismatch", "false as is_duplicate", "cast(null as string) as risk_flag")
    row = analytics.confidence(df).first()
    assert (row["confidence_score"], row["confidence_reasons"]) == (45, "missing_date,missing_amount")


def test_previous_row_across_blocks(spark):
    df = rows(spark, *[(0, 0, i * i) for i in range(23)])
    for block in (1, 4, 7, 100):
        found = {r["row_idx"]: r["b"] for r in previous(df, block, b=F.col("balance")).collect()}
        assert found == {i: (i - 1) ** 2 if i else None for i in range(23)}


def test_circular_needs_both_directions(spark):
    df = rows(spark, *[(5, 0, 0)] * 5)
    both = df.withColumn("description", F.expr("if(row_idx = 0, 'received from zed', 'transfer out to zed')"))
    one = df.withColumn("description", F.lit("transfer out to zed"))
    assert alerts.circular(both).count() == 5 and alerts.circular(one).count() == 0


def test_circular_rows_lose_points_and_have_the_last_flag(spark):
    df = rows(spark, (0, 7, 7), *[(5, 0, b) for b in (2, -3, -8, -13)]).withColumn("description", F.expr("if(row_idx = 0, 'received from bet365', 'transfer out to bet365')"))
    scored = analytics.confidence(alerts.flag_circular(balance.reconcile(df)).withColumn("is_duplicate", F.lit(False)).withColumn("risk_flag", F.expr("if(is_circular, 'circularTrading', null)")))
    assert {(r["confidence_score"], r["confidence_reasons"]) for r in scored.collect()} == {(95, "risk_flag")}
    assert [r["circularTrading"] for r in alerts.findings(df).collect()] == [5]


def test_signs_move_to_the_other_side(spark):
    df = rows(spark, (-5, 0, 0), (0, -6, 0), (-5, 7, 0), (-5, -6, 0), (None, -3, 0))
    assert [(r["debit"], r["credit"]) for r in cleaning.normalize_signs(df).orderBy("row_idx").collect()] == [(0, 5), (6, 0), (5, 7), (0, 5), (3, 0)]


def test_only_transactions_stay(spark):
    cases = [("2024-01-05", "Opening balance", 0), ("2024-01-05", "Opening balance", 5), ("soon", "x", 5), ("5 May", "x", 5), ("1/2/24", None, 5), (None, "x", 5), ("2024-01-05", "x", 0)]
    df = spark.createDataFrame([(1, i, d, t, "r", a, 0, 0) for i, (d, t, a) in enumerate(cases)], SCHEMA)
    assert [r["row_idx"] for r in cleaning.transactions_only(df).orderBy("row_idx").collect()] == [1, 3, 4]
    assert [r["row_idx"] for r in cleaning.accepted(df).orderBy("row_idx").collect()] == [0, 1, 2, 3, 6]


def test_words_are_repaired_and_keys_hold_names_only(spark):
    row = spark.sql("select '  oww  Marrioitt\tXOWW ' as a, 'UPI-REF AB12CD Alice  & Bob no 77' as b").select(cleaning.repair_text(F.col("a")), cleaning.narration_key(F.col("b"))).first()
    assert tuple(row) == ("O/W MARRIOTT XOWW", "alice bob")


def test_statistics_of_few_and_many_amounts(spark):
    df = rows(spark, *[(0, c, 0) for c in (10, 1000, 30, 20, 40)])
    r = statistics.amount_statistics(df).first()
    assert (r["n_amounts"], r["median"], r["robust_mean"]) == (5, 30.0, 30.0)
    one = statistics.amount_statistics(rows(spark, (0, 10, 0))).first()
    assert (one["deviation"], one["variation"], one["robust_mean"]) == (0.0, 0.0, 10.0)
    assert statistics.amount_statistics(rows(spark, (0, 0, 0))).count() == 0
    low = statistics.low_balance_frequency(rows(spark, (0, 0, 100_000), (0, 0, -5), (0, 0, 2_000_000), (0, 0, 200_000), (0, 0, None))).first()
    assert (low["threshold"], low["low_share"]) == (100_000.0, 0.5)


def test_reversed_statements_fit_backwards(spark):
    # newest row first: each balance follows from the row below
    df = rows(spark, (0, 5, 15), (0, 10, 10), (0, 0, 0))
    r = statistics.direction_mismatch(df).first()
    assert (r["forward"], r["reversed"], r["mismatch_ratio"]) == (1.0, 0.0, 0.0)
    assert {r["row_idx"]: r["a"] for r in following(df, 2, a=F.col("balance")).collect()} == {0: 10, 1: 0, 2: None}


def test_circular_groups(spark):
    df = rows(spark, (0, 7, 0), *[(5, 0, 0)] * 4).withColumn("description", F.expr("if(row_idx = 0, 'received from zed', 'transfer out to zed')"))
    assert [tuple(r) for r in alerts.circular_groups(df).collect()] == [(1, "zed", 1, 4, 27)]


def test_closing_passes_over_zero_and_absent_balances(spark):
    days = [("2024-01-05", 10), ("2024-01-09", 0), ("2024-01-09", 8), ("2024-01-07", 5), ("2024-02-01", None)]
    df = spark.createDataFrame([(1, i, d, "x", "r", 1, 0, b) for i, (d, b) in enumerate(days)], SCHEMA)
    assert sorted((r["month"], r["closing"], r["net"]) for r in analytics.monthly_cashflow(df).collect()) == [("2024-01", 10, -4), ("2024-02", 0, -1)]


def test_csv_fields_are_quoted_where_needed_and_nulls_are_empty(spark):
    df = rows(spark, (5, 0, -1250)).withColumn("description", F.lit('a "b", c')).withColumn("ref_number", F.lit(None).cast("string"))
    lines = [r["line"] for r in exports.csv_lines(df, total=True).orderBy("part").collect()]
    assert lines[1:] == ['2024-01-01,"a ""b"", c",Other,0.05,,-12.50,', ",TOTAL,,0.05,0.00,,"]


def test_flow_of_a_single_row_and_without_balances(spark):
    assert flow.balance_flow(rows(spark, (0, 0, 1))).first()["mismatch_ratio"] == 0.0
    assert flow.balance_flow(rows(spark, (0, 0, None), (0, 0, None))).first()["mismatch_ratio"] == 1.0


def salaried(spark, months=6, salary=5_000_000, instalment=1_000_000):
    """A salary on the first and a home loan on the fifth of each month."""
    values = []
    for m in range(1, months + 1):
        values += [(1, len(values), f"2024-{m:02}-01", "ACME payroll", "r", 0, salary, 9_000_000), (1, len(values) + 1, f"05/{m:02}/2024", "Home loan nach", "r", instalment, 0, 8_000_000)]
    return spark.createDataFrame(values, SCHEMA)


def test_steady_salary_and_one_loan(spark):
    r = underwriting.underwrite(salaried(spark)).first()
    # income 50000 and instalment 10000 a month: 20 % of a cap of 50 %
    assert (r["consistency"], r["avg_income"], r["avg_instalment"], r["ratio"], r["cap"], r["ratio_status"], r["grade"]) == (100, 5_000_000, 1_000_000, 20.0, 50.0, "excellent", "excellent")
    assert (r["headroom"], r["max_new_instalment"], r["loan_months"], r["message"]) == (1_500_000, 1_380_000, 72, underwriting.MESSAGES[0])
    assert r["factors"] == ["Income consistency score: 100%", "Low-balance frequency: 0.0%", "FOIR 20.0% vs cap 50.0%", "Recurring salary months: 6/6"]
    types = underwriting.instalments_by_type(underwriting.recurring(salaried(spark)))
    assert [tuple(t) for t in types.collect()] == [(1, "Housing", 6, 6_000_000)]


def test_no_salary_is_not_eligible_and_unknown_dates_count_for_the_first_month(spark):
    df = spark.createDataFrame([(1, 0, None, "car loan", None, 600_000, None, None), (1, 1, "2024-03-09", None, None, None, None, None), (1, 2, "2024-02-09", "", "", 0, 0, 0)], SCHEMA)
    months = underwriting.monthly_income(df, underwriting.recurring(df))
    assert sorted((m["month"], m["instalment_outflow"]) for m in months.collect()) == [("2024-02", 600_000), ("2024-03", 0)]
    r = underwriting.underwrite(df).first()
    assert (r["grade"], r["message"], r["avg_income"], r["avg_instalment"]) == ("ineligible", underwriting.NO_ROOM, 0, 450_000)


def test_corrections_by_whole_text_then_by_part(spark):
    df = spark.createDataFrame([("Shop", "Old"), ("shop two", "Old"), (None, "Old")], "description string, category string")
    found = df.select(underwriting.corrected_category(F.col("description"), F.col("category"), [("sho", "Part"), ("shop", "Whole")]).alias("c"))
    assert [r["c"] for r in found.collect()] == ["Whole", "Part", "Old"]
    loans = underwriting.recurring(salaried(spark, instalment=0).withColumn("description", F.lit("gift")), [("gift", "Salary/Income")])
    assert {r["side"] for r in loans.collect()} == {"salary"}


def test_tiers_hide_terms(spark):
    result = underwriting.underwrite(salaried(spark))
    shown = {plan: underwriting.masked(result, underwriting.plan_tier(F.lit(plan))).first() for plan in ("unlimited", " PER_PAGE_STANDARD ", "per_page_lite", "free", None)}
    assert shown["free"] is None and shown[None] is None
    assert shown["unlimited"]["cap"] == 50.0 and shown[" PER_PAGE_STANDARD "]["cap"] is None
    assert len(shown[" PER_PAGE_STANDARD "]["factors"]) == 4 and shown["per_page_lite"]["factors"] == []


def test_empty_ledger(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for run in (underwriting.underwrite, underwriting.recurring, balance.reconcile, flow.balance_flow, flow.delta_anomalies, flow.statement_summary, alerts.circular, alerts.findings, exports.csv_lines, exports.iif_lines, balance.audit, balance.liquidity, analytics.totals, analytics.category_breakdown, analytics.monthly_cashflow, analytics.high_risk, cleaning.normalize_signs, cleaning.transactions_only, cleaning.accepted, statistics.amount_statistics, statistics.low_balance_frequency, statistics.cash_share, statistics.instalments, statistics.direction_mismatch, statistics.date_order):
        assert run(empty).count() == 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
