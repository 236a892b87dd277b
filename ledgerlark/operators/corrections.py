"""Category corrections of a user, as a table that is joined with narrations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Narrations and patterns meet by so many characters of the pattern's beginning.
HEAD = 4


def correct_categories(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """rows with corrected_category: that of the correction whose pattern is the lower-case description, else of the first that it contains, else the category.

    corrections: pattern (lower-case), category, priority (the first counts; of equal ones, the smaller pattern). Any number of
    them: different descriptions are joined by equality, and by the pieces of up to HEAD characters with which a pattern
    begins; what meets is then searched. Null or empty patterns match nothing. Extra columns stay.
    """
    known = corrections.where("pattern <> ''").select("pattern", F.struct("priority", "pattern", F.col("category").alias("label")).alias("rule"))
    text = F.lower(F.coalesce("description", F.lit("")))
    texts = rows.select(text.alias("_text")).distinct()
    equal = texts.join(known, texts["_text"] == known["pattern"]).groupBy("_text").agg(F.min("rule").alias("equal"))
    # every piece of 1 to HEAD characters of a text
    places = F.sequence(F.lit(1), F.length("_text"))
    pieces = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(HEAD)), lambda n: F.transform(places, lambda i: F.substring(F.col("_text"), i, n))))
    offered = texts.where("_text <> ''").select("_text", F.explode(F.array_distinct(pieces)).alias("head"))
    heads = known.withColumn("head", F.substring("pattern", 1, HEAD))
    part = offered.join(heads, "head").where(F.contains("_text", "pattern")).groupBy("_text").agg(F.min("rule").alias("part"))
    found = equal.join(part, "_text", "full").select("_text", F.coalesce("equal.label", "part.label").alias("_label"))
    joined = rows.withColumn("_text", text).join(found, "_text", "left")
    return joined.withColumn("corrected_category", F.coalesce("_label", "category")).drop("_text", "_label")
