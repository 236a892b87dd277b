"""References by every weight and every guard."""

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions.references import best_reference


@pytest.mark.parametrize("field, description, found", [
    ("UTR: ABC12/99 AE12345", "x", "ABC12/99"),  # a label beats a prefix
    ("paid AE12345 S123456", None, "AE12345"), ("paid S123456 FCFABCDEF1", "x", "S123456"), ("to FCFABCDEF9 or XYZ12345", "zz", "FCFABCDEF9"), ("to XYZ12345A or 12345678-AB", "zz", "XYZ12345A"),
    ("no 12345678-AB at all", "x", "12345678-AB"), ("a b c d e 1234567890", "x", "1234567890"), ("#R-77/x.", "x", "R-77/x"), ("PLAINREF", "x", "PLAINREF"),
    ("1234567", "x", "1234567"), ("abc", "x", None), ("05/06/2024", "x", None), ("12:30:10", "x", None), ("", "x", None), (None, "x", None), (" #:- ", "x", None),
    ("one two three four five six seven AE12345", "x", None), ("A" * 81, "x", None), ("POS purchase mall", "pos purchase mall dubai", None), ("AE12345", "AE12345", "AE12345"),
    ("salary transfer", "x", "salary transfer"), ("AE12345 AE99999", "x", "AE12345"),
])
def test_best_reference(spark, field, description, found):
    df = spark.createDataFrame([(field, description)], "f string, d string")
    assert df.select(best_reference(F.col("f"), F.col("d"))).first()[0] == found
