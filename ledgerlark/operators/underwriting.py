"""Underwriting of a statement: salary and instalment rows, income stability, obligation ratio, eligibility.

Amounts are in minor units. Candidate rows share a bucket if statement, side and narration key agree; a bucket's months, amounts and
hits return to its rows, which are then scored. Missing amounts are zero, missing text is empty, rows without a readable month count for
the statement's first month, and an empty ledger gives no rows. ``row_idx`` names a row of a statement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.money import clamp, half_up
from ledgerlark.functions.rules import category
from ledgerlark.sources.shared import written

from .cleaning import narration_key
from .statistics import CASH, low_balance_frequency

# Words of salaries, of credits that are none, of transfers.
SALARY = ["salary", "sal cr", "sal/", "payroll", "wages", "income", "stipend", "pension", "honorarium", "pay credit", "monthly pay", "wps",
          "salary transfer", "salary credit"]
NO_SALARY = ["refund", "reversal", "cashback", "interest", "invoice", "rent", "rental", "security deposit", "loan disbursal", "credit card payment"]
TRANSFER = ["neft", "rtgs", "imps", "ach", "ecs", "upi"]
# Words of instalments, of mandates, of lenders, of expenses.
INSTALMENT = ["emi", "loan", "instalment", "installment", "repayment", "housing loan", "home loan", "car loan", "personal loan",
              "credit card bill", "mortgage", "finance"]
MANDATE = ["nach", "ecs", "ach", "auto debit", "autodebit", "standing instruction", "e mandate", "emandate"]
LENDER = ["hdfc", "icici", "axis", "sbi", "kotak", "bajaj", "federal", "nbfc", "capital", "finance", "bank ltd"]
EXPENSE = ["atm", "cash withdrawal", "cash wdl", "cash withdraw", "pos", "purchase", "shopping", "swipe", "fuel", "restaurant", "grocery",
           "bill payment", "utility"]
# Loan types and their words, in order of precedence.
LOAN_TYPES = [
    ("Housing", ["housing", "home loan", "mortgage"]), ("Vehicle", ["car", "vehicle", "auto loan"]), ("Personal", ["personal", "pl "]),
    ("Credit Card", ["credit card", "cc "]), ("Education", ["education", "student"]), ("Gold", ["gold"]), ("EMI", INSTALMENT),
]
# Bounds of the least salary and its share of the median credit (without credits: the usual one); least instalment.
FLOOR_LOW, FLOOR_HIGH, FLOOR_SHARE, FLOOR_USUAL, LEAST_INSTALMENT = 300_000, 1_800_000, 0.55, 600_000, 35_000
# Income below which a cap on the obligation ratio holds, in percent; the cap beyond.
CAPS, CAP_BEYOND = [(4_000_000, 45), (10_000_000, 50), (25_000_000, 55)], 60
# Grades from best to worst.
GRADES = ["excellent", "good", "moderate", "poor", "ineligible"]
# What is said of a grade, of a missing salary stream, of no and of tight head room.
MESSAGES = [
    "Strong FOIR, stable income flow, and healthy repayment headroom.",
    "Healthy FOIR and acceptable income stability for standard lending profiles.",
    "FOIR is near policy cap. Conservative ticket sizing is recommended.",
    "FOIR is above comfort zone. Additional risk mitigation is required.",
    "FOIR is materially above policy cap for fresh loan servicing.",
]
NO_STREAM = "No stable salary stream detected. FOIR-based eligibility is limited."
NO_ROOM = "No safe EMI headroom available for new loan servicing."
TIGHT = "Headroom is tight after stress adjustment; lend conservatively."
# Plans that show more than the basic result; other plans by the page show the basic one.
ADVANCED_PLANS = ["per_page_power", "per_page_pack_pro", "per_page_pack_enterprise", "unlimited"]
PRO_PLANS = ["per_page_standard", "per_page_pack_basic"]
#: Corrections are a parameter, not data: more belong in a table that is joined.
MOST_CORRECTIONS = 10_000

_ISO, _DAY_FIRST = r"^\d{4}-\d{2}-\d{2}$", r"^\d{2}[/-]\d{2}[/-]\d{4}$"


def month_key(date: Column) -> Column:
    """yyyy-mm of ISO and day-first dates, else the first seven characters, else ``unknown``."""
    text = F.trim(F.coalesce(date, F.lit("")))
    day_first = F.concat(F.substring(text, 7, 4), F.lit("-"), F.substring(text, 4, 2))
    return F.when(text.rlike(_DAY_FIRST), day_first).when(F.length(text) >= 7, F.substring(text, 1, 7)).otherwise("unknown")


def day_of_month(date: Column) -> Column:
    """Day of ISO and day-first dates, else null."""
    text = F.trim(F.coalesce(date, F.lit("")))
    return F.when(text.rlike(_ISO), F.substring(text, 9, 2)).when(text.rlike(_DAY_FIRST), F.substring(text, 1, 2)).cast("int")


def corrected_category(description: Column, known: Column, corrections: Sequence[tuple[str, str]]) -> Column:
    """The category of the correction that equals the lower-case narration, else of the first that it contains, else the known one."""
    if len(corrections) > MOST_CORRECTIONS:
        raise ValueError(f"{len(corrections)} corrections are over {MOST_CORRECTIONS}")
    if not corrections:
        return known
    text = F.lower(F.coalesce(description, F.lit("")))
    pairs = F.array(*[F.struct(F.lit(pattern).alias("pattern"), F.lit(label).alias("label")) for pattern, label in corrections])
    first = lambda test: F.try_element_at(F.filter(pairs, test), F.lit(1))["label"]
    return F.coalesce(first(lambda p: p["pattern"] == text), first(lambda p: F.contains(text, p["pattern"])), known)


def loan_type(text: Column) -> Column:
    """Loan type of a lower-case narration."""
    found = F.lit("Unknown")
    for label, words in reversed(LOAN_TYPES):
        found = F.when(_has(text, words), label).otherwise(found)
    return found


def _has(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def _points(*tests: tuple[int, Column]) -> Column:
    """Sum of the points of the tests that hold."""
    total = F.lit(0)
    for points, test in tests:
        total = total + F.when(test, points).otherwise(0)
    return total


def prepared(ledger: DataFrame, corrections: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """The columns that the analysis needs, computed once for each row and written; all operators here also take these for a ledger."""
    if "by_words" in ledger.columns:
        return ledger
    known = category(F.col("description"), F.col("category") if "category" in ledger.columns else None)
    text = F.lower(F.coalesce("description", F.lit("")))
    label = F.lower(F.trim(corrected_category(F.col("description"), known, corrections)))
    amount = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = ledger.select(
        "statement_id", "row_idx", "date", amount("debit").alias("debit"), amount("credit").alias("credit"), "balance", text.alias("text"),
        label.alias("label"), month_key(F.col("date")).alias("month"), narration_key(F.col("description")).alias("key"),
    )
    cash_words = _has(F.col("text"), CASH)
    return written(rows.withColumns({"by_words": cash_words, "cash_only": ~cash_words & (F.col("label") == "cash")}), "underwriting")


def salary_floor(rows: DataFrame) -> DataFrame:
    """Per statement with credits: the least amount that looks like a salary. Equal amounts are counted first."""
    counted = rows.where("credit > 0").groupBy("statement_id", "credit").agg(F.count(F.lit(1)).alias("n"))
    middle = counted.groupBy("statement_id").agg(F.expr("percentile(credit, 0.5, n)").alias("middle"))
    return middle.select("statement_id", clamp(half_up(F.col("middle") * FLOOR_SHARE), FLOOR_LOW, FLOOR_HIGH).cast("long").alias("floor"))


def candidates(ledger: DataFrame, corrections: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rows that may be a salary or an instalment, with what their words say; a row with both amounts may be both."""
    rows = prepared(ledger, corrections)
    rows = rows.join(salary_floor(rows), "statement_id", "left").withColumn("floor", F.coalesce("floor", F.lit(FLOOR_USUAL).cast("long")))
    text, label, none = F.col("text"), F.col("label"), F.lit(False)

    def side(name: str, amount: str, words: Column, labelled: Column, mandate: Column, hint: Column, excluded: Column, large: Column) -> Column:
        fields = {"amount": F.col(amount), "words": words, "labelled": labelled, "mandate": mandate, "hint": hint, "excluded": excluded}
        found = F.struct(F.lit(name).alias("side"), *[value.alias(field) for field, value in fields.items()])
        return F.when((F.col(amount) > 0) & (words | labelled | mandate | hint | large), found)

    salary = side("salary", "credit", _has(text, SALARY), label == "salary/income", none, _has(text, TRANSFER), _has(text, NO_SALARY), F.col("credit") >= F.col("floor"))
    expense = _has(text, EXPENSE)
    instalment = side("instalment", "debit", _has(text, INSTALMENT), label == "loan/emi", _has(text, MANDATE), _has(text, LENDER), expense, (F.col("debit") >= LEAST_INSTALMENT) & ~expense)
    return rows.withColumn("found", F.explode(F.array_compact(F.array(salary, instalment)))).select("*", "found.*").drop("found")


def buckets(found: DataFrame) -> DataFrame:
    """Per bucket of candidates: rows, months (1 at least), median, coefficient of variation, share of excluded rows."""
    counted = found.groupBy("statement_id", "side", "key", "amount", "month").agg(F.count(F.lit(1)).alias("n"), F.count_if("excluded").alias("out"))
    x, n = F.col("amount").cast("double"), F.col("n")
    sums = counted.groupBy("statement_id", "side", "key").agg(
        F.sum("n").alias("n_rows"),
        F.greatest(F.lit(1), F.size(F.collect_set(F.when(F.col("month") != "unknown", F.col("month"))))).alias("months"),
        F.expr("percentile(amount, 0.5, n)").alias("median"),
        F.sum(F.col("amount") * n).alias("total"),
        F.sum(x * x * n).alias("squares"),
        F.sum("out").alias("out"),
    )
    mean = F.col("total") / F.col("n_rows")
    variation = F.when(F.col("n_rows") <= 1, 0.0).otherwise(_deviation("n_rows", "total", "squares") / mean)
    return sums.select("statement_id", "side", "key", "n_rows", "months", "median", variation.alias("variation"), (F.col("out") / F.col("n_rows")).alias("excluded_share"))


def _deviation(n: str, total: str, squares: str) -> Column:
    mean = F.try_divide(F.col(total), F.col(n))
    return F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col(squares), F.col(n)) - mean * mean))


def recurring(ledger: DataFrame, corrections: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """The candidates accepted as salary or instalment, with score and (instalments) loan type."""
    found = written(candidates(ledger, corrections), "candidates")
    c = F.col
    scored = found.join(buckets(found), ["statement_id", "side", "key"])
    plain = ~c("words") & ~c("labelled")
    salary = _points(
        (3, c("words")), (3, c("labelled")), (1, c("amount") >= c("floor")), (2, c("months") >= 2), (1, c("variation") <= 0.42), (1, c("months") >= 3),
        (-1, c("hint") & plain), (-3, c("excluded")), (-1, c("excluded_share") > 0.45),
    )
    instalment = _points(
        (3, c("words")), (3, c("labelled")), (2, c("mandate")), (1, c("hint")), (2, c("months") >= 2), (1, c("variation") <= 0.3),
        (1, c("amount") >= 100_000), (-3, c("excluded")), (-1, (c("excluded_share") > 0.45) & plain),
    )
    is_salary = c("side") == "salary"
    strong_salary = (c("months") >= 2) & (c("variation") <= 0.35) & (c("median") >= c("floor") * 0.8)
    strong_instalment = (c("months") >= 3) & (c("variation") <= 0.22) & (c("median") >= LEAST_INSTALMENT) & (c("excluded_share") < 0.35)
    scored = scored.withColumn("score", F.when(is_salary, salary).otherwise(instalment))
    least = F.when(is_salary, c("floor") * 0.55).otherwise(LEAST_INSTALMENT)
    strong = F.when(is_salary, strong_salary).otherwise(strong_instalment)
    taken = ((c("score") >= 4) & (c("amount") >= least)) | ((c("score") >= 3) & strong) | (c("labelled") & (c("score") >= 2))
    return scored.where(taken).withColumn("loan_type", F.when(~is_salary, loan_type(c("text"))))


def instalments_by_type(accepted: DataFrame) -> DataFrame:
    """Per statement and loan type: number and sum of the accepted instalments."""
    rows = accepted.where("side = 'instalment'")
    return rows.groupBy("statement_id", "loan_type").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amount").alias("total"))


def monthly_income(ledger: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per statement and month of the ledger: salaries and instalments (0 if none), their number, sums of salary days.

    Rows of an unknown month belong to the statement's first month: the least yyyy-mm, else the least other text.
    """
    months = ledger.groupBy("statement_id", month_key(F.col("date")).alias("month")).agg(F.count(F.lit(1)).alias("n_rows"))
    salary, day = F.col("side") == "salary", day_of_month(F.col("date"))
    pick = lambda test, value: F.sum(F.when(test, value).otherwise(0))
    sums = accepted.groupBy("statement_id", "month").agg(
        pick(salary, F.col("amount")).alias("salary_income"), pick(~salary, F.col("amount")).alias("instalment_outflow"), F.count_if(salary).alias("n_salary"),
        F.count(F.when(salary, day)).alias("n_days"), pick(salary & day.isNotNull(), day).alias("days"), pick(salary & day.isNotNull(), day * day).alias("day_squares"),
    )
    order = F.struct(F.col("month") == "unknown", ~F.col("month").rlike(r"^\d{4}-\d{2}$"), F.col("month"))
    first = F.min_by("month", order).over(Window.partitionBy("statement_id"))
    joined = months.join(sums, ["statement_id", "month"], "left").withColumn("month", F.when(F.col("month") == "unknown", first).otherwise(F.col("month")))
    names = ["salary_income", "instalment_outflow", "n_salary", "n_days", "days", "day_squares"]
    return joined.groupBy("statement_id", "month").agg(*[F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name) for name in names])


def _cash(ledger: DataFrame, accepted: DataFrame, corrections: Sequence[tuple[str, str]]) -> DataFrame:
    """Per statement: share of its debits that are cash by words or by category, where accepted rows have left their category."""
    debit = F.greatest(F.col("debit"), F.lit(0))
    rows = prepared(ledger, corrections).groupBy("statement_id").agg(F.sum(debit).alias("debits"), F.sum(F.when(F.col("by_words") | F.col("cash_only"), debit).otherwise(0)).alias("cash"))
    moved = accepted.where("cash_only AND debit > 0").dropDuplicates(["statement_id", "row_idx"]).groupBy("statement_id").agg(F.sum("debit").alias("moved"))
    share = (F.col("cash") - F.coalesce("moved", F.lit(0))) / F.col("debits")
    return rows.join(moved, "statement_id", "left").select("statement_id", F.when(F.col("debits") > 0, share).otherwise(0.0).alias("cash_share"))


def stability(months: DataFrame) -> DataFrame:
    """Per statement: income consistency (0 to 100) and the averages of income and instalments that follow from it."""
    c = F.col

    def active(name: str, short: str) -> list[Column]:
        x = F.when(c(name) > 0, c(name))
        parts = {"n": F.count(x), "sum": F.coalesce(F.sum(x), F.lit(0)), "squares": F.sum(x.cast("double") * x), "low": F.min(x), "high": F.max(x)}
        return [value.alias(f"{short}_{part}") for part, value in parts.items()]

    def robust(short: str) -> Column:
        n, total = c(f"{short}_n"), c(f"{short}_sum")
        return F.when(n >= 5, (total - c(f"{short}_low") - c(f"{short}_high")) / (n - 2)).when(n > 0, total / n).otherwise(0.0)

    sums = [F.sum(name).alias(name) for name in ("n_salary", "n_days", "days", "day_squares")]
    per = months.groupBy("statement_id").agg(F.count(F.lit(1)).alias("months"), *active("salary_income", "s"), *active("instalment_outflow", "e"), *sums)
    variation = F.when(c("s_n") > 1, F.try_divide(_deviation("s_n", "s_sum", "s_squares"), c("s_sum") / c("s_n"))).when(c("s_n") == 1, 0.62).otherwise(1.0)
    spread = F.when(c("n_days") > 1, _deviation("n_days", "days", "day_squares")).when(c("n_days") == 1, 6.0).otherwise(12.0)
    none = c("n_salary") == 0
    steady = clamp(100 - variation * 140, 0.0, 100.0) * 0.5 + clamp(c("s_n") / c("months") * 100, 0.0, 100.0) * 0.3 + clamp(100 - spread * 11, 30.0, 100.0) * 0.2
    per = per.withColumn("consistency", F.when(none, 0).otherwise(half_up(steady)).cast("long")).withColumn("income_active", robust("s"))
    factor = F.when(none, 0.0).otherwise(clamp(0.55 + c("consistency") / 200, 0.55, 1.0))
    income = half_up(F.greatest(c("s_sum") / c("months"), c("income_active") * 0.75) * factor).cast("long")
    spent = half_up(F.greatest(c("e_sum") / c("months"), robust("e") * F.when(c("e_n") >= 2, 0.9).otherwise(0.75))).cast("long")
    return per.select("statement_id", "months", c("s_n").alias("salary_months"), "n_salary", "consistency", "income_active", income.alias("avg_income"), spent.alias("avg_instalment"))


def obligation_ratio(profile: DataFrame) -> DataFrame:
    """Adds ratio, cap, head room and the loan that it carries, from averages, consistency, low-balance and cash shares."""
    c = F.col

    def cap_of(income: Column) -> Column:
        found = F.lit(float(CAP_BEYOND))
        for bound, cap in reversed(CAPS):
            found = F.when(income < bound, float(cap)).otherwise(found)
        return found

    short = lambda least, by: F.greatest(F.lit(0.0), (least - c("consistency")) / by)
    weak = F.when(c("consistency") >= 70, 0.0).otherwise((70 - c("consistency")) * 0.12)
    base = cap_of(F.greatest(c("avg_income").cast("double"), c("income_active")))
    cap = F.greatest(F.lit(32.0), F.least(base, base - weak - c("low_share") * 14 - c("cash_share") * 10))
    stress = clamp(0.92 - c("low_share") * 0.22 - c("cash_share") * 0.16 - short(65, 250), 0.62, 0.92)
    rate = 0.11 + c("low_share") * 0.03 + c("cash_share") * 0.02 + short(58, 600)
    income, spent = c("avg_income"), c("avg_instalment")
    months = F.when(c("consistency") >= 80, 72).when(c("consistency") >= 60, 60).otherwise(48)
    df = profile.withColumns(
        {
            "ratio": F.when(income > 0, half_up(spent / income * 10_000) / 100).otherwise(0.0),
            "cap": half_up(cap * 100) / 100,
            "stress": stress,
            "yearly_rate": clamp(half_up(rate * 10_000) / 10_000, 0.06, 0.24),
            "loan_months": months,
            "disposable": F.greatest(F.lit(0), income - spent),
        }
    )
    use = c("ratio") / c("cap") * 100
    df = df.withColumns(
        {
            "ratio_status": F.when(use <= 70, "excellent").when(use <= 90, "good").when(use <= 110, "moderate").otherwise("high"),
            "headroom": F.greatest(F.lit(0), half_up(income * c("cap") / 100) - spent).cast("long"),
        }
    )
    df = df.withColumn("max_new_instalment", F.least(half_up(c("headroom") * c("stress")), half_up(c("disposable") * 0.6)).cast("long"))
    growth = F.pow(1 + c("yearly_rate") / 12, c("loan_months"))
    principal = c("max_new_instalment") * ((growth - 1) / (c("yearly_rate") / 12 * growth))
    return df.withColumn("loan_amount", half_up(principal).cast("long"))


def eligibility(ratios: DataFrame) -> DataFrame:
    """Adds the grade after all downgrades, and the factors that led to it, in order."""
    c = F.col
    use = c("ratio") / c("cap")
    steady = lambda least: c("consistency") >= least
    no_stream = (c("avg_income") <= 0) & (c("n_salary") == 0)
    start = (
        F.when(no_stream, 2).when((use <= 0.65) & steady(75), 0).when((use <= 0.85) & steady(60), 1).when(use <= 1.0, 2).when(use <= 1.15, 3).otherwise(4)
    )
    lower = lambda test: F.when(test, 1).otherwise(0)
    grade = F.least(F.lit(4), start + lower(c("consistency") < 45) + lower(c("low_share") >= 0.35) + lower(c("cash_share") >= 0.4))
    no_room = c("max_new_instalment") <= 0
    message = F.when(no_stream, F.lit(NO_STREAM)).otherwise(F.element_at(F.array(*map(F.lit, MESSAGES)), start + 1))
    lost = no_room & ((use > 1) | (c("avg_income") <= 0))
    message = F.when(lost, F.lit(NO_ROOM)).when(no_room & (grade < 4), F.lit(TIGHT)).otherwise(message)
    grade = F.when(lost, 4).when(no_room, F.least(F.lit(4), grade + 1)).otherwise(grade)
    tenth = lambda form, x: F.format_string(form, half_up(x * 10) / 10)
    whole = lambda form: F.format_string(form, c("consistency"))
    low, cash = c("low_share") * 100, c("cash_share") * 100
    factors = F.array(
        F.when(no_stream, F.lit("No recurring salary credits detected")),
        F.when(c("consistency") < 45, whole("Income consistency is weak (%d%%)")).otherwise(whole("Income consistency score: %d%%")),
        F.when(c("low_share") >= 0.35, tenth("Low-balance frequency is elevated (%.1f%%)", low)).otherwise(tenth("Low-balance frequency: %.1f%%", low)),
        F.when(c("cash_share") >= 0.4, tenth("High cash withdrawal reliance (%.1f%% of debits)", cash)).when(c("cash_share") >= 0.2, tenth("Cash withdrawals are moderate (%.1f%% of debits)", cash)),
        F.format_string("FOIR %.1f%% vs cap %.1f%%", half_up(c("ratio") * 10) / 10, half_up(c("cap") * 10) / 10),
        F.format_string("Recurring salary months: %d/%d", c("salary_months"), c("months")),
        F.when(no_room, F.lit("No incremental EMI capacity after stress adjustment")),
    )
    return ratios.withColumns({"grade": F.element_at(F.array(*map(F.lit, GRADES)), grade + 1), "message": message, "factors": F.array_compact(factors)})


def underwrite(ledger: DataFrame, corrections: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """The whole analysis, one row per statement."""
    ledger = prepared(ledger, corrections)
    accepted = written(recurring(ledger, corrections), "accepted")
    profile = stability(monthly_income(ledger, accepted))
    low = low_balance_frequency(ledger).select("statement_id", "low_share")
    profile = profile.join(low, "statement_id", "left").withColumn("low_share", F.coalesce("low_share", F.lit(0.0)))
    return eligibility(obligation_ratio(profile.join(_cash(ledger, accepted, corrections), "statement_id", "left").withColumn("cash_share", F.coalesce("cash_share", F.lit(0.0)))))


def plan_tier(plan: Column) -> Column:
    """What a plan shows of the result: advanced, pro, basic or none (unknown and missing plans)."""
    name = F.lower(F.trim(F.coalesce(plan, F.lit(""))))
    return F.when(name.isin(ADVANCED_PLANS), "advanced").when(name.isin(PRO_PLANS), "pro").when(name.startswith("per_page"), "basic").otherwise("none")


def masked(result: DataFrame, tier: Column) -> DataFrame:
    """The result as a tier shows it: none loses the row, basic the factors, all but advanced the terms behind the ratio."""
    shown = result.withColumn("tier", tier).where("tier <> 'none'")
    advanced = F.col("tier") == "advanced"
    terms = ["disposable", "cap", "headroom", "yearly_rate", "loan_months"]
    hidden = {name: F.when(advanced, F.col(name)) for name in terms}
    return shown.withColumns(hidden | {"factors": F.when(F.col("tier") != "basic", F.col("factors")).otherwise(F.array().cast("array<string>"))})
