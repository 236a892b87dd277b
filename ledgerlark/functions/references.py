"""The reference number in a reference field: all matches of weighted patterns, scored, and the best of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import let, tidy

# Patterns of references and their weights (group 1 is the reference), a whole field's weight, words that are none.
PATTERNS = [
    (r"(?i)\b(?:ref(?:erence)?(?:\s*no)?|txn(?:\s*id)?|transaction(?:\s*id)?|utr|rrn|imps|neft|rtgs|tr\s*ref|chq(?:ue)?(?:\s*no)?)\b[^\S\r\n]*[:#-]?[^\S\r\n]*([A-Za-z0-9Xx./-]{5,})", 60),
    (r"(?i)\b(AE\d{5,})\b", 58), (r"(?i)\b(S\d{5,})\b", 54), (r"(?i)\b(FCF[A-Z0-9]{6,})\b", 52), (r"(?i)\b([A-Z]{3,}\d{5,}[A-Z0-9]*)\b", 48),
    (r"(?i)\b([A-Z0-9]{8,}(?:-[A-Z0-9]{2,})+)\b", 46), (r"\b([0-9Xx]{10,20})\b", 42),
]
WHOLE, WHOLE_LENGTH, WHOLE_WORDS = 32, 40, 4
LEAST_LENGTH, MOST_WORDS, MOST_LENGTH, REPEATS_TEXT = 5, 6, 80, 12
NO_REFERENCE = ["transfer", "purchase", "property", "salary", "bank charges", "monthly account", "customer credit", "government"]
DATE_OR_TIME = r"^(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|\d{1,2}:\d{2}(?::\d{2})?)$"


def reference_token(text: Column) -> Column:
    """A reference without the marks around it; null is empty."""
    return F.regexp_replace(F.regexp_replace(tidy(F.coalesce(text, F.lit(""))), r"^[\s#:/.-]+", ""), r"[\s#:/.-]+$", "")


def _score(value: Column, weight: Column) -> Column:
    points = lambda n, test: F.when(test, n).otherwise(0)
    lower = F.lower(value)
    return (
        weight + points(20, value.rlike("[A-Za-z]") & value.rlike("[0-9]")) + points(8, ~F.contains(value, F.lit(" "))) + points(10, F.length(value).between(6, 28)) - points(25, F.length(value) > 60)
        - points(18, F.exists(F.array(*map(F.lit, NO_REFERENCE)), lambda w: F.contains(lower, w))) - points(20, value.rlike("^[A-Za-z]+$")) - points(20, value.rlike("^[0-9]{1,7}$"))
    )


def best_reference(field: Column, description: Column) -> Column:
    """The best reference in a field, or null: the first of the highest score, counted by its first and so weightiest pattern.

    Fields of more than MOST_WORDS words or MOST_LENGTH characters are narrations, as are those longer than REPEATS_TEXT that
    contain the description or are part of it. Dates, times and references of a negative score are none.
    """

    def best(raw: Column) -> Column:
        weighted = lambda w: lambda x: F.struct(reference_token(x).alias("value"), F.lit(w).alias("weight"))
        matched = [F.transform(F.regexp_extract_all(field, F.lit(pattern), 1), weighted(weight)) for pattern, weight in PATTERNS]
        few = (F.length(raw) <= WHOLE_LENGTH) & (F.size(F.split(raw, " ")) <= WHOLE_WORDS)
        whole = F.filter(F.array(F.struct(raw.alias("value"), F.lit(WHOLE).alias("weight"))), lambda x: few)
        every = F.filter(F.concat(*matched, whole), lambda x: F.length(x["value"]) >= LEAST_LENGTH)

        def scored(found: Column) -> Column:
            return let(F.transform(found, lambda x: x["value"]), lambda values: highest(found, values))

        def highest(found: Column, values: Column) -> Column:
            first = F.filter(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: F.array_position(values, y["x"]["value"]) == y["i"] + 1)
            points = F.transform(first, lambda y: F.struct(_score(y["x"]["value"], y["x"]["weight"]).alias("score"), (-y["i"]).alias("before"), y["x"]["value"].alias("value")))
            return F.array_max(F.filter(points, lambda p: (p["score"] >= 0) & ~p["value"].rlike(DATE_OR_TIME)))["value"]

        told = F.lower(reference_token(description))
        same = let(F.struct(F.lower(raw).alias("raw"), told.alias("told")), lambda x: (x["told"] != "") & (F.contains(x["raw"], x["told"]) | F.contains(x["told"], x["raw"])))
        narration = (F.size(F.split(raw, " ")) > MOST_WORDS) | (F.length(raw) > MOST_LENGTH) | ((F.length(raw) > REPEATS_TEXT) & same)
        return F.when((raw != "") & ~narration, let(every, scored))

    return let(reference_token(field), best)
