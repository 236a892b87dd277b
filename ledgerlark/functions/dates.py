"""The date grammars of statements, as Columns. Each reads the forms of one place in the flow; they disagree on purpose.

A grammar names the forms that it knows. One pattern with all of them takes a text apart, and its groups are gathered by
their role (year, month number, month name, day); no text has two of these forms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and their numbers.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
# The years of packed dates, and what stands for a month or date that can't be read.
PACKED_YEARS, NO_MONTH, NO_DATE = (1990, 2099), "undefined", "UNKNOWN"
#: White space as scripts of the web know it; Java's \s is ASCII.
SPACE = r"[\s   -     　﻿]+"

# Forms of a date, and the roles of their groups (y year, m month, n month name, d day).
ISO = (r"(\d{4})-(\d{2})-(\d{2})", "ymd")
YMD = (r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})", "ymd")
YMD_TIME = (r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})(?:[T\s].*)?", "ymd")
DMY = (r"(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})", "dmy")
DAY_NAME_YEAR = (r"(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{2,4})", "dny")
DAY_NAME_COMMA_YEAR = (r"(\d{1,2})\s+([A-Za-z]{3,9}),?\s+(\d{2,4})", "dny")
DAY_NAME_MARK_YEAR = (r"(\d{1,2})[-/ ]([A-Za-z]{3,9})[-/ ](\d{2,4})", "dny")
DAY_NAME = (r"(\d{1,2})[-/ ]([A-Za-z]{3,9})[-/]?", "dn")
NAME_DAY_YEAR = (r"([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{2,4})", "ndy")
NAME_DAY = (r"([A-Za-z]{3,9})\s+(\d{1,2})", "nd")
NAME_YEAR = (r"([A-Za-z]{3,9})\s+(\d{2,4})", "ny")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def tidy(text: Column) -> Column:
    """White space of any kind made one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}$", "")


def month_number(name: Column) -> Column:
    """1 to 12, or null if the name is none of a month."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair]), F.lower(name))


def number(digits: Column) -> Column:
    return digits.try_cast("int")


def read(clean: Column, forms: list[tuple[str, str]], then: Callable[[Column], Column]) -> Column:
    """then(struct of year (text), month (int, by number or name), name, day (int)) of a text in one of the forms, else null.

    What a form lacks is null; a month name that is unknown gives a null month.
    """
    pattern, roles = "^(?:" + "|".join(f for f, _ in forms) + ")$", "".join(r for _, r in forms)
    mark = "\u0001"  # what is written between the groups; a text that begins with it and isn't taken apart has too few of them or reads as null
    parts = F.split(F.regexp_replace(clean, pattern, mark + mark.join(f"${i + 1}" for i in range(len(roles)))), mark)

    def gather(p: Column) -> Column:
        role = lambda r: F.nullif(F.concat_ws("", *[F.get(p, i + 1) for i, x in enumerate(roles) if x == r]), F.lit("")) if r in roles else F.lit(None).cast("string")
        by_role = F.struct(role("y").alias("year"), F.coalesce(number(role("m")), month_number(role("n"))).alias("month"), role("n").alias("name"), number(role("d")).alias("day"))
        return F.when((F.size(p) == len(roles) + 1) & (F.get(p, 0) == ""), by_role)

    return let(let(parts, gather), lambda r: F.when(r.isNotNull(), then(r)))


def pivoted(year: Column, pivot: bool = True) -> Column:
    """A year token: two digits are of 2000 to 2049 or 1950 to 1999 (without pivot: of 2000 to 2099), others a number."""
    y = number(year)
    return y + F.when(F.length(year) == 2, F.when((y < 50) | F.lit(not pivot), 2000).otherwise(1900)).otherwise(0)


def below_hundred(year: Column, pivot: bool = True) -> Column:
    """As pivoted, for every number below 100, however many digits it was written in."""
    y = number(year)
    return y + F.when(y < 100, F.when((y < 50) | F.lit(not pivot), 2000).otherwise(1900)).otherwise(0)


def _pad(x: Column, n: int = 2) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat(_pad(year, 4), F.lit("-"), _pad(month), F.lit("-"), _pad(day))


def _calendar(month: Column, day: Column) -> Column:
    """A month and a day that some month has: 31/02 passes."""
    return day.between(1, 31) & month.between(1, 12)


def rolled(year: Column, month: Column, day: Column, centuries: bool = True) -> Column:
    """The date that many months and days from the year's first; what is too large rolls over. With centuries, a year below 100 is of 1900."""
    year = F.when((year < 100) & F.lit(centuries), year + 1900).otherwise(year)
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), day - 1)


def statement_date(text: Column) -> Column:
    """ISO text of a statement's date, or null: Y-M-D (also with a time), D/M/Y, D Mon Y, Mon D Y, Mon Y (its first day).

    Days up to 31 pass in every month. Two-digit years pivot at 50.
    """
    def found(r: Column) -> Column:
        day = F.coalesce(r["day"], F.lit(1))
        return F.when(_calendar(r["month"], day), _iso(pivoted(r["year"]), r["month"], day))

    return read(tidy(text), [YMD_TIME, DMY, DAY_NAME_COMMA_YEAR, NAME_DAY_YEAR, NAME_YEAR], found)


def statement_day(text: Column) -> Column:
    """The date of statement_date; 31/02 rolls over to the days after the month."""
    part = lambda p, i: number(F.get(p, i))
    return let(F.split(statement_date(text), "-"), lambda p: rolled(part(p, 0), part(p, 1), part(p, 2)))


def merge_day(text: Column) -> Column:
    """The date by which statements are merged: a leading numeric date, else statement_day.

    Four digits first are Y-M-D. Otherwise the first number is the day, unless only the second can be one; years aren't
    pivoted, so 24 is 1924, and what is too large rolls over.
    """
    def found(r: Column) -> Column:  # year: the first number, month: the second, name: the third
        first, second, third = number(r["year"]), r["month"], r["day"]
        american = (first <= 12) & (second > 12)
        return F.when(F.length(r["year"]) == 4, rolled(first, second, third)).otherwise(
            rolled(third, F.when(american, first).otherwise(second), F.when(american, second).otherwise(first))
        )

    numeric = read(trimmed(text), [(r"(\d{1,4})[/-](\d{1,2})[/-](\d{1,4})[\s\S]*", "ymd")], found)
    return F.coalesce(numeric, statement_day(text))


def scanned_date(text: Column, default_year: Column | None = None) -> Column:
    """ISO-like text of a date in scanned rows, or null. Nothing is checked but the month's name.

    A date without a year takes the default year, as does one whose year is 0 to 31: scans repeat the day in its place.
    """
    default = F.lit(None).cast("string") if default_year is None else F.nullif(default_year.cast("string"), F.lit(""))
    full = lambda y: F.when(F.length(y) == 2, F.concat(F.when(number(y) < 50, "20").otherwise("19"), y)).otherwise(y)

    def found(r: Column) -> Column:
        token = F.when(r["name"].isNull(), r["year"]).when(r["year"].isNull() | (number(r["year"]) <= 31), F.coalesce(default, r["year"])).otherwise(r["year"])
        return F.concat(full(token), F.lit("-"), _pad(r["month"]), F.lit("-"), _pad(r["day"]))

    def either(clean: Column) -> Column:
        named = read(clean, [DMY, DAY_NAME_MARK_YEAR, DAY_NAME, NAME_DAY_YEAR, NAME_DAY], found)
        return F.coalesce(F.when(clean.rlike(f"^{ISO[0]}$"), clean), named)

    return let(trimmed(text), either)


def line_date(text: Column, names_checked: bool = False) -> Column:
    """ISO text of a date in text lines, else the text with single spaces: D/M/Y, D Mon Y, Mon D Y, years below 100 pivot at 50.

    An unknown month name gives a text with ``undefined`` for the month; with names_checked (the batch's form) it is no date.
    """
    def found(r: Column) -> Column:
        known = r["month"].between(1, 12) | (r["name"].isNotNull() & r["month"].isNull() & F.lit(not names_checked))
        month = F.coalesce(_pad(r["month"]), F.lit(NO_MONTH))
        return F.when(known & r["day"].between(1, 31), F.concat(_pad(below_hundred(r["year"]), 4), F.lit("-"), month, F.lit("-"), _pad(r["day"])))

    return F.coalesce(read(tidy(text), [DMY, DAY_NAME_YEAR, NAME_DAY_YEAR], found), tidy(text))


def period_day(text: Column) -> Column:
    """The date of one end of a statement period: numbers aren't checked and roll over; else statement_day."""
    found = read(tidy(text), [YMD, DMY, DAY_NAME_COMMA_YEAR, NAME_DAY_YEAR], lambda r: rolled(pivoted(r["year"]), r["month"], r["day"]))
    return F.coalesce(found, statement_day(text))


def ledger_day(text: Column) -> Column:
    """The date by which a ledger's direction is judged: ISO or D/M/Y with two-digit years of 2000 to 2099, else named months.

    A month beyond 12, a day beyond 31 or a year of three digits is no date; days up to 31 roll over.
    """
    def found(r: Column) -> Column:
        return F.when(_calendar(r["month"], r["day"]) & (F.length(r["year"]) != 3), rolled(pivoted(r["year"], pivot=False), r["month"], r["day"], centuries=False))

    named = F.when(~trimmed(text).rlike(r"^\d+[/-]\d+[/-]\d+$"), statement_day(text))
    return F.coalesce(read(trimmed(text), [ISO, DMY], found), named)


def coded_date(text: Column) -> Column:
    """ISO text of an ISO or D/M/Y date (years below 100 are of 2000), else UNKNOWN."""
    clean = tidy(text)
    found = read(clean, [DMY], lambda r: F.when(_calendar(r["month"], r["day"]), _iso(below_hundred(r["year"], pivot=False), r["month"], r["day"])))
    return F.coalesce(F.when(clean.rlike(f"^{ISO[0]}$"), clean), found, F.lit(NO_DATE))


def embedded_date(text: Column) -> Column:
    """ISO text of the first full date inside a text (DD/MM/YYYY, then DD-MM-YYYY, then YYYY/MM/DD), else the text; null is empty."""
    text = F.coalesce(text, F.lit(""))
    out = F.when(text.rlike(f"^{ISO[0]}$"), text)
    for pattern, order in ((r"(\d{2})/(\d{2})/(\d{4})", (3, 2, 1)), (r"(\d{2})-(\d{2})-(\d{4})", (3, 2, 1)), (r"(\d{4})/(\d{2})/(\d{2})", (1, 2, 3))):
        out = out.when(text.rlike(pattern), F.concat_ws("-", *[F.regexp_extract(text, pattern, i) for i in order]))
    return out.otherwise(text)


def is_packed_date(text: Column) -> Column:
    """Whether six or eight digits can be a date of 1990 to 2099: DDMMYY, DDMMYYYY or YYYYMMDD. Null is none."""
    part = lambda at, n: number(F.substring(text, at, n))
    dated = lambda y, m, d: y.between(*PACKED_YEARS) & _calendar(m, d)
    long = dated(part(1, 4), part(5, 2), part(7, 2)) | dated(part(5, 4), part(3, 2), part(1, 2))
    short = dated(below_hundred(F.substring(text, 5, 2)), part(3, 2), part(1, 2))
    return F.coalesce(F.when(text.rlike(r"^\d{8}$"), long).when(text.rlike(r"^\d{6}$"), short), F.lit(False))
