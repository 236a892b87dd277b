"""URL filters by temporal list join: every capture is judged by the list entries active when it was fetched.

Entries are dated events (list, kind, pattern, action, day). A pattern's events on one list become validity intervals
[valid_from, valid_to): an ``add`` opens one, the next event of the pattern closes it. A ``domain`` pattern matches its
host and the hosts below it; a ``prefix`` pattern (host and path) matches that path and the paths below it. Captures
look entries up by equality on every domain suffix and path prefix of their URL, with the day inside the interval.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, unused

BROADCAST_ROWS = 50_000
SALTS = 16

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url) -> F.Column:
    """Lower-case host of a URL; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """entries: list, kind (domain/prefix), pattern, action (add/remove), day -> list, kind, pattern, valid_from, valid_to.

    Entries with a null field, an empty pattern or another action are ignored; of several events of a pattern on one day an add wins;
    adds of an open pattern change nothing; valid_to is null while an interval is open.
    """
    key = ["list", "kind", "pattern"]
    known = entries.where(F.col("action").isin("add", "remove")).dropna(subset=[*key, "day"]).where("pattern <> ''")
    # one event for each day of a pattern, so a window holds at most as many rows as there are days
    daily = known.groupBy(*key, "day").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    w = Window.partitionBy(*key).orderBy("day")
    changes = daily.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(0))).where(F.col("on") != F.col("was"))
    return changes.withColumn("valid_to", F.lead("day").over(w)).where(F.col("on") == 1).select(*key, F.col("day").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """All columns of captures and host, n_active (matching entries active on the day), matched (the longest active pattern), verdict.

    verdict is the list of the longest active pattern ("block" before any other list on a tie, then by name), "none" if
    no entry is active. A null or unparsable URL has host "" and verdict "none"; a null day matches nothing.
    Repeated captures stay; columns of captures named like the results are replaced.
    """
    captures = captures.drop(*({"host", "n_active", "matched", "verdict"} & set(captures.columns)))
    valid = intervals(entries).select(
        F.concat("kind", F.lit(":"), F.lower(F.regexp_extract("pattern", "^[^/]*", 0)), F.regexp_replace("pattern", "^[^/]*", "")).alias("_key"),
        F.col("list").alias("_list"), F.col("pattern").alias("_pattern"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"),
    )
    # every capture is looked up by its number, which is written so that both sides of the last join mean the same rows
    number = unused("_number", captures)
    rows = cut(captures.withColumn(number, F.monotonically_increasing_id()), "captures")
    labels = F.split(host(F.col(url)), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    steps = F.split(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), _PATH, 1), "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda i: F.concat(F.lit("prefix:"), host(F.col(url)), F.array_join(F.slice(steps, F.lit(1), i), "/")),
    )
    keyed = rows.select(F.col(number).alias("_id"), F.col(day).alias("_day"), F.explode(F.array_distinct(F.concat(suffixes, prefixes))).alias("_key"))
    if valid.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        valid, on = F.broadcast(valid), ["_key"]
    else:  # a popular domain's captures are dealt over the salts, of which each has all entries
        valid = valid.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed, on = keyed.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")), ["_key", "_salt"]
    hits = keyed.join(valid, on).where((F.col("_from") <= F.col("_day")) & (F.col("_to").isNull() | (F.col("_day") < F.col("_to"))))
    best = F.struct(F.length("_pattern").alias("size"), (F.col("_list") == "block").cast("int").alias("block"), F.col("_list").alias("list"), F.col("_pattern").alias("pattern"))
    judged = hits.groupBy("_id").agg(F.count(F.lit(1)).alias("n_active"), F.max(best).alias("best"))
    # of a capture without an active entry there is no row
    n_active, found = unused("_active", rows), unused("_found", rows)
    judged = judged.select(F.col("_id").alias(number), F.col("n_active").alias(n_active), F.col("best").alias(found))
    return rows.join(judged, number, "left").select(
        *captures.columns,
        host(F.col(url)).alias("host"),
        F.coalesce(n_active, F.lit(0)).alias("n_active"),
        F.coalesce(F.col(found)["pattern"], F.lit("")).alias("matched"),
        F.coalesce(F.col(found)["list"], F.lit("none")).alias("verdict"),
    )
