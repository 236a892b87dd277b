"""Named underwriting queries with their SQL for DuckDB, over the ledger of orders (years of fifty statements)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlark.operators import cleaning
from ledgerlark.operators import underwriting as uw

from .queries import _CATEGORY, add

_SPACED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
_KEY = rf"regexp_replace(regexp_replace(regexp_replace(lower(description), '[a-z]*[0-9]+[a-z0-9]*', ' ', 'g'), '\b(?:{cleaning.RAILS})\b', ' ', 'g'), '[^a-z\s]', ' ', 'g')"


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


_LOANS = "CASE " + " ".join(f"WHEN {_has(words)} THEN '{name}'" for name, words in uw.LOAN_TYPES) + " ELSE 'Unknown' END"
_ROWS = f"""base AS (SELECT statement_id, row_idx, date, debit, credit, balance, substr(date, 1, 7) AS month, CAST(substr(date, 9, 2) AS INTEGER) AS day,
    lower(description) AS t, lower({_CATEGORY}) AS label, substr({_SPACED.format(_KEY)}, 1, {cleaning.KEY_LENGTH}) AS key FROM ledger),
  lows AS (SELECT *, coalesce(least(1800000, greatest(300000, floor(median(CASE WHEN credit > 0 THEN credit END) OVER (PARTITION BY statement_id) * 0.55::DOUBLE + 0.5))), 600000) AS low FROM base),
  found AS (SELECT *, 'salary' AS side, credit AS amount, {_has(uw.SALARY)} AS words, label = 'salary/income' AS labelled, false AS mandate, {_has(uw.TRANSFER)} AS hint, {_has(uw.NO_SALARY)} AS out
      FROM lows WHERE credit > 0 AND ({_has(uw.SALARY)} OR label = 'salary/income' OR {_has(uw.TRANSFER)} OR credit >= low)
    UNION ALL SELECT *, 'instalment', debit, {_has(uw.INSTALMENT)}, label = 'loan/emi', {_has(uw.MANDATE)}, {_has(uw.LENDER)}, {_has(uw.EXPENSE)}
      FROM lows WHERE debit > 0 AND ({_has(uw.INSTALMENT + uw.MANDATE + uw.LENDER)} OR label = 'loan/emi' OR (debit >= 35000 AND NOT {_has(uw.EXPENSE)}))),
  pots AS (SELECT statement_id, side, key, count(*) AS n_rows, greatest(1, count(DISTINCT month)) AS months, median(amount)::DOUBLE AS mid,
      CASE WHEN count(*) <= 1 THEN 0 ELSE stddev_pop(amount) / avg(amount) END AS cv, count(*) FILTER (WHERE out)::DOUBLE / count(*) AS outs FROM found GROUP BY ALL),
  scored AS (SELECT *, CASE side WHEN 'salary' THEN 3 * words::INT + 3 * labelled::INT + (amount >= low)::INT + 2 * (months >= 2)::INT + (cv <= 0.42)::INT + (months >= 3)::INT
        - (hint AND NOT words AND NOT labelled)::INT - 3 * out::INT - (outs > 0.45)::INT
      ELSE 3 * words::INT + 3 * labelled::INT + 2 * mandate::INT + hint::INT + 2 * (months >= 2)::INT + (cv <= 0.3)::INT + (amount >= 100000)::INT
        - 3 * out::INT - (outs > 0.45 AND NOT words AND NOT labelled)::INT END AS score FROM found JOIN pots USING (statement_id, side, key)),
  taken AS (SELECT *, {_LOANS} AS loan FROM scored WHERE (labelled AND score >= 2) OR CASE side
      WHEN 'salary' THEN (score >= 4 AND amount >= low * 0.55::DOUBLE) OR (score >= 3 AND months >= 2 AND cv <= 0.35 AND mid >= low * 0.8::DOUBLE)
      ELSE (score >= 4 AND amount >= 35000) OR (score >= 3 AND months >= 3 AND cv <= 0.22 AND mid >= 35000 AND outs < 0.35) END)"""
_MONTHS = """monthly AS (SELECT b.statement_id, b.month, coalesce(sum(k.amount) FILTER (WHERE side = 'salary'), 0)::BIGINT AS salary_income,
    coalesce(sum(k.amount) FILTER (WHERE side = 'instalment'), 0)::BIGINT AS instalment_outflow
  FROM (SELECT DISTINCT statement_id, month FROM base) b LEFT JOIN taken k USING (statement_id, month) GROUP BY ALL)"""


def _robust(x: str) -> str:
    n = f"count(*) FILTER (WHERE {x} > 0)"
    total = f"sum({x}) FILTER (WHERE {x} > 0)"
    low = f"min({x}) FILTER (WHERE {x} > 0)"
    return f"CASE WHEN {n} >= 5 THEN ({total} - {low} - max({x}))::DOUBLE / ({n} - 2) WHEN {n} > 0 THEN {total}::DOUBLE / {n} ELSE 0 END"


_CASHED = " OR ".join(f"contains(b.t, '{w}')" for w in uw.CASH)
_PROFILE = f"""days AS (SELECT statement_id, count(*) AS n_salary, CASE WHEN count(*) = 1 THEN 6 ELSE stddev_pop(day) END AS spread FROM taken WHERE side = 'salary' GROUP BY 1),
  sums AS (SELECT statement_id, count(*) AS months, count(*) FILTER (WHERE salary_income > 0) AS salary_months,
    CASE count(*) FILTER (WHERE salary_income > 0) WHEN 0 THEN 1 WHEN 1 THEN 0.62 ELSE stddev_pop(salary_income) FILTER (WHERE salary_income > 0) / avg(salary_income) FILTER (WHERE salary_income > 0) END AS cv,
    {_robust("salary_income")} AS income_active, sum(salary_income)::DOUBLE / count(*) AS income_all, {_robust("instalment_outflow")} AS spent_active,
    sum(instalment_outflow)::DOUBLE / count(*) AS spent_all, count(*) FILTER (WHERE instalment_outflow > 0) AS spent_months FROM monthly GROUP BY 1),
  marks AS (SELECT s.*, coalesce(n_salary, 0) AS n_salary, CASE WHEN n_salary IS NULL THEN 0 ELSE CAST(floor(0.5 + greatest(0, least(100, 100 - cv * 140)) * 0.5
      + least(100, salary_months::DOUBLE / months * 100) * 0.3 + greatest(30, least(100, 100 - spread * 11)) * 0.2) AS BIGINT) END AS consistency FROM sums s LEFT JOIN days USING (statement_id)),
  profile AS (SELECT statement_id, months, salary_months, n_salary, consistency, income_active,
    CAST(floor(0.5 + greatest(income_all, income_active * 0.75::DOUBLE) * CASE WHEN n_salary = 0 THEN 0 ELSE greatest(0.55::DOUBLE, least(1, 0.55::DOUBLE + consistency / 200::DOUBLE)) END) AS BIGINT) AS avg_income,
    CAST(floor(0.5 + greatest(spent_all, spent_active * CASE WHEN spent_months >= 2 THEN 0.9::DOUBLE ELSE 0.75::DOUBLE END)) AS BIGINT) AS avg_instalment FROM marks)"""
_RATIO = f"""lowest AS (SELECT statement_id, count(*) FILTER (WHERE balance <= limits)::DOUBLE / count(*) AS low_share FROM (SELECT statement_id, balance,
      coalesce(greatest(100000::DOUBLE, 0.12::DOUBLE * median(balance) FILTER (WHERE balance > 0) OVER (PARTITION BY statement_id)), 100000::DOUBLE) AS limits FROM ledger) GROUP BY 1),
  cashed AS (SELECT b.statement_id, CASE WHEN sum(b.debit) > 0 THEN coalesce(sum(b.debit) FILTER (WHERE {_CASHED} OR (b.label = 'cash' AND k.row_idx IS NULL)), 0)::DOUBLE / sum(b.debit) ELSE 0 END AS cash_share
    FROM base b LEFT JOIN (SELECT DISTINCT statement_id, row_idx FROM taken) k USING (statement_id, row_idx) GROUP BY 1),
  joined AS (SELECT *, CASE WHEN greatest(avg_income, income_active) < 4000000 THEN 45 WHEN greatest(avg_income, income_active) < 10000000 THEN 50
    WHEN greatest(avg_income, income_active) < 25000000 THEN 55 ELSE 60 END::DOUBLE AS top FROM profile JOIN lowest USING (statement_id) JOIN cashed USING (statement_id)),
  capped AS (SELECT *, CASE WHEN avg_income > 0 THEN floor(avg_instalment::DOUBLE / avg_income * 10000 + 0.5) / 100 ELSE 0 END AS ratio,
    floor(100 * greatest(32, least(top, top - CASE WHEN consistency >= 70 THEN 0 ELSE (70 - consistency) * 0.12::DOUBLE END - low_share * 14 - cash_share * 10)) + 0.5) / 100 AS cap,
    greatest(0.62::DOUBLE, least(0.92::DOUBLE, 0.92::DOUBLE - low_share * 0.22::DOUBLE - cash_share * 0.16::DOUBLE - greatest(0, (65 - consistency) / 250::DOUBLE))) AS stress,
    least(0.24::DOUBLE, floor(10000 * (0.11::DOUBLE + low_share * 0.03::DOUBLE + cash_share * 0.02::DOUBLE + greatest(0, (58 - consistency) / 600::DOUBLE)) + 0.5) / 10000) AS yearly_rate,
    CASE WHEN consistency >= 80 THEN 72 WHEN consistency >= 60 THEN 60 ELSE 48 END AS loan_months, greatest(0, avg_income - avg_instalment) AS disposable FROM joined),
  roomy AS (SELECT *, ratio / cap AS used, CAST(greatest(0, floor(avg_income * cap / 100 + 0.5) - avg_instalment) AS BIGINT) AS headroom FROM capped),
  ratios AS (SELECT *, CASE WHEN used <= 0.7 THEN 'excellent' WHEN used <= 0.9 THEN 'good' WHEN used <= 1.1 THEN 'moderate' ELSE 'high' END AS ratio_status,
    CAST(least(floor(headroom * stress + 0.5), floor(disposable * 0.6::DOUBLE + 0.5)) AS BIGINT) AS max_new_instalment FROM roomy)"""
_GRADED = f"""starts AS (SELECT *, avg_income <= 0 AND n_salary = 0 AS no_stream, CASE WHEN avg_income <= 0 AND n_salary = 0 THEN 2 WHEN used <= 0.65 AND consistency >= 75 THEN 0
      WHEN used <= 0.85 AND consistency >= 60 THEN 1 WHEN used <= 1 THEN 2 WHEN used <= 1.15 THEN 3 ELSE 4 END AS step FROM ratios),
  steps AS (SELECT *, least(4, step + (consistency < 45)::INT + (low_share >= 0.35)::INT + (cash_share >= 0.4)::INT) AS lowered, max_new_instalment <= 0 AND (used > 1 OR avg_income <= 0) AS lost FROM starts)"""
VIEWS = (_ROWS, _MONTHS, _PROFILE, _RATIO, _GRADED)


def _tenth(form: str, x: str) -> str:
    return f"printf('{form}', floor({x} * 10 + 0.5) / 10)"


add(
    "recurring_buckets",
    lambda df: uw.buckets(uw.candidates(df)).withColumns({"variation": F.round("variation", 6)}),
    "SELECT statement_id, side, key, n_rows, months::INTEGER AS months, mid AS median, round(cv, 6) AS variation, outs AS excluded_share FROM pots",
    kind="orders",
    views=VIEWS[:1],
)
add(
    "salary_credits",
    lambda df: uw.recurring(df).where("side = 'salary'").select("statement_id", "row_idx", "date", "amount", "score"),
    "SELECT statement_id, row_idx, date, amount, score::INTEGER AS score FROM taken WHERE side = 'salary'",
    kind="orders",
    views=VIEWS[:1],
)
add(
    "instalment_debits",
    lambda df: uw.recurring(df).where("side = 'instalment'").select("statement_id", "row_idx", "date", "amount", "score", "loan_type"),
    "SELECT statement_id, row_idx, date, amount, score::INTEGER AS score, loan AS loan_type FROM taken WHERE side = 'instalment'",
    kind="orders",
    views=VIEWS[:1],
)
add(
    "instalments_by_type",
    lambda df: uw.instalments_by_type(uw.recurring(df)),
    "SELECT statement_id, loan AS loan_type, count(*) AS n_rows, sum(amount)::BIGINT AS total FROM taken WHERE side = 'instalment' GROUP BY ALL",
    views=VIEWS[:1],
)
add(
    "monthly_income",
    lambda df: uw.monthly_income(df, uw.recurring(df)).select("statement_id", "month", "salary_income", "instalment_outflow"),
    "SELECT * FROM monthly",
    kind="orders",
    views=VIEWS[:2],
)
add(
    "income_stability",
    lambda df: uw.stability(uw.monthly_income(df, uw.recurring(df))).withColumn("income_active", F.round("income_active", 4)),
    "SELECT * REPLACE (round(income_active, 4) AS income_active) FROM profile",
    kind="orders",
    views=VIEWS[:3],
)
_RATIO_COLUMNS = ["statement_id", "avg_income", "avg_instalment", "ratio", "cap", "ratio_status", "yearly_rate", "loan_months", "disposable", "headroom", "max_new_instalment"]
add(
    "obligation_ratio",
    lambda df: uw.underwrite(df).select(*_RATIO_COLUMNS, F.round(F.col("loan_amount") / 100, 0).alias("loan_units")),
    f"""SELECT {', '.join(_RATIO_COLUMNS)}, round(floor(max_new_instalment * ((pow(1 + yearly_rate / 12, loan_months) - 1) / (yearly_rate / 12 * pow(1 + yearly_rate / 12, loan_months))) + 0.5) / 100, 0) AS loan_units
        FROM ratios""",
    kind="orders",
    views=VIEWS[:4],
)
_SAID = f"CASE WHEN lost THEN '{uw.NO_ROOM}' WHEN max_new_instalment <= 0 AND lowered < 4 THEN '{uw.TIGHT}' WHEN no_stream THEN '{uw.NO_STREAM}' " + " ".join(
    f"WHEN step = {i} THEN '{m}'" for i, m in enumerate(uw.MESSAGES)
) + " END"
add(
    "eligibility",
    lambda df: uw.underwrite(df).select("statement_id", "grade", "message", F.array_join("factors", "; ").alias("factors")),
    f"""SELECT statement_id, list_extract({uw.GRADES}, 1 + CASE WHEN lost THEN 4 WHEN max_new_instalment <= 0 THEN least(4, lowered + 1) ELSE lowered END) AS grade, {_SAID} AS message,
        concat_ws('; ', CASE WHEN no_stream THEN 'No recurring salary credits detected' END,
          CASE WHEN consistency < 45 THEN printf('Income consistency is weak (%d%%)', consistency) ELSE printf('Income consistency score: %d%%', consistency) END,
          CASE WHEN low_share >= 0.35 THEN {_tenth("Low-balance frequency is elevated (%.1f%%)", "low_share * 100")} ELSE {_tenth("Low-balance frequency: %.1f%%", "low_share * 100")} END,
          CASE WHEN cash_share >= 0.4 THEN {_tenth("High cash withdrawal reliance (%.1f%% of debits)", "cash_share * 100")}
               WHEN cash_share >= 0.2 THEN {_tenth("Cash withdrawals are moderate (%.1f%% of debits)", "cash_share * 100")} END,
          printf('FOIR %.1f%% vs cap %.1f%%', floor(ratio * 10 + 0.5) / 10, floor(cap * 10 + 0.5) / 10), printf('Recurring salary months: %d/%d', salary_months, months),
          CASE WHEN max_new_instalment <= 0 THEN 'No incremental EMI capacity after stress adjustment' END) AS factors FROM steps""",
    kind="orders",
    views=VIEWS,
)

_PLANS = ["unlimited", " PER_PAGE_STANDARD ", "per_page_lite", "free", "per_page_power"]
_PLAN = "CASE statement_id % 6 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PLANS)) + " END"
_SHOWN = ["statement_id", "avg_income", "ratio", "cap", "disposable", "headroom", "yearly_rate", "loan_months"]
add(
    "tiered_results",
    lambda df: uw.masked(uw.underwrite(df), uw.plan_tier(F.expr(_PLAN))).select(*_SHOWN, "tier", F.size("factors").alias("n_factors")),
    f"""SELECT {', '.join(_SHOWN[:3])}, {', '.join(f"CASE WHEN tier = 'advanced' THEN {c} END AS {c}" for c in _SHOWN[3:])}, tier,
        CAST(CASE WHEN tier = 'basic' THEN 0 ELSE 4 + CASE WHEN no_stream THEN 1 ELSE 0 END + CASE WHEN cash_share >= 0.2 THEN 1 ELSE 0 END + CASE WHEN max_new_instalment <= 0 THEN 1 ELSE 0 END END AS INTEGER) AS n_factors
        FROM (SELECT *, CASE lower(trim(coalesce({_PLAN}, ''))) WHEN 'unlimited' THEN 'advanced' WHEN 'per_page_power' THEN 'advanced' WHEN 'per_page_standard' THEN 'pro' WHEN 'per_page_lite' THEN 'basic' ELSE 'none' END AS tier FROM steps)
        WHERE tier <> 'none'""",
    kind="orders",
    views=VIEWS,
)
