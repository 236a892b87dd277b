"""Joined category corrections against the rule stated row by row."""

import numpy as np

from ledgerlark.operators.corrections import correct_categories


def test_corrections_match_a_plain_search(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abé "), int(n)))
    rules = [(word(rng.integers(0, 7)), f"c{int(rng.integers(4))}", int(rng.integers(5))) for _ in range(60)] + [(None, "none", 0), ("abababab", "long", 0)]
    texts = [None, "", "AB", "abababab"] + [word(rng.integers(0, 15)).upper() for _ in range(150)]
    rows = spark.createDataFrame([(i, t, "known", 1) for i, t in enumerate(texts)] * 2, "row_idx long, description string, category string, pattern int").repartition(3)
    found = correct_categories(rows, spark.createDataFrame(rules, "pattern string, category string, priority int"))
    assert found.columns == ["row_idx", "description", "category", "pattern", "corrected_category"]
    for r in found.collect():
        text = (r["description"] or "").lower()
        hits = sorted((p != text, n, p, c) for p, c, n in rules if p and p in text)
        assert r["corrected_category"] == (hits[0][3] if hits else "known")
    assert found.count() == 2 * len(texts)


def test_no_corrections(spark):
    rows = spark.createDataFrame([(1, "x", None)], "row_idx long, description string, category string")
    none = spark.createDataFrame([], "pattern string, category string, priority int")
    assert [r["corrected_category"] for r in correct_categories(rows, none).collect()] == [None]
    assert correct_categories(rows.limit(0), none).count() == 0
