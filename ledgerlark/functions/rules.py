"""Keyword rules of classifiers. Matching is unanchored: a keyword also matches inside a longer word."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and patterns in order of precedence (the first match wins).
CATEGORIES = [
    ("Salary/Income", "salary|sal cr|payroll|wages|stipend|pension|honorarium|commission|bonus"),
    ("Transfer In", "credit|transfer.*in|received|deposit|neft cr|rtgs cr|imps cr|upi cr"),
    ("Transfer Out", "transfer.*out|sent|paid to|neft dr|rtgs dr|imps dr|upi"),
    ("Bills & Utilities", "electricity|electric|power|water|gas|internet|broadband|wifi|phone|mobile|rent|utility"),
    ("Shopping", "amazon|flipkart|myntra|ajio|shopee|retail|fashion|clothes|electronics|store"),
    ("Food & Dining", "swiggy|zomato|uber eats|restaurant|cafe|coffee|food|dining|grocery|supermarket|bigbasket"),
    ("Transportation", "uber|ola|rapido|fuel|petrol|diesel|parking|toll|metro|bus|train|cab|taxi"),
    ("Entertainment", "netflix|spotify|prime|hotstar|movies|cinema|gaming|subscription|youtube"),
    ("Healthcare", "hospital|clinic|pharmacy|medical|doctor|health|apollo|medplus|1mg"),
    ("Education", "school|college|university|course|tuition|books|education|udemy|coursera"),
    ("Insurance", "insurance|premium|policy|lic|icici prudential|hdfc life|bajaj allianz"),
    ("Investments", "mutual fund|mf|sip|stock|share|trading|zerodha|groww|upstox|fd|rd|fixed deposit"),
    ("Loan/EMI", "emi|loan|instalment|installment|repayment|nach|auto debit|mandate|finance"),
    ("Cash", "atm|cash withdrawal|cash deposit|cdm|self withdrawal"),
    ("Bank Fees", "charge|fee|penalty|service charge|maintenance|gst|tax deducted"),
]
# Keywords of high-risk rows.
HIGH_RISK = [
    ("gambling", ["bet365", "betway", "dream11", "stake", "casino", "poker", "gambling", "lottery", "rummy", "betting", "sportingbet",
                  "888", "ladbrokes", "william hill", "paddy power", "betfair"]),
    ("paydayLoan", ["payday", "quickloan", "fastcash", "instantloan", "moneynow", "cashadvance", "short term loan", "quick money",
                    "emergency loan", "same day loan", "instant cash"]),
    ("bouncedPayment", ["cheque return", "ecs return", "nach return", "dishonor", "bounce", "returned unpaid", "insufficient funds",
                        "payment failed", "rejection", "return charges", "dishonoured"]),
]


def category(description: Column, known: Column | None = None) -> Column:
    """The known category if there is one, else that of the first pattern that matches, else Other."""
    text, found = F.lower(F.coalesce(description, F.lit(""))), F.lit("Other")
    for label, pattern in reversed(CATEGORIES):
        found = F.when(text.rlike(pattern), label).otherwise(found)
    return found if known is None else F.coalesce(F.nullif(known, F.lit("")), found)


def risk_types(description: Column) -> Column:
    """All risk types of a row, in fixed order."""
    text = F.lower(F.coalesce(description, F.lit("")))
    return F.array_compact(F.array(*[F.when(text.rlike("|".join(words)), name) for name, words in HIGH_RISK]))
