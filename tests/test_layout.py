"""Lines and columns of placed tokens."""

import numpy as np

from ledgerlark.operators import layout

TOKENS = "statement_id long, page int, x double, y double, text string"


def test_amounts_by_columns():
    at = lambda tokens, text="": layout._anchored(tokens, text, 335, 415, 501)
    assert at([(100, "903389"), (227, "030POSB26091066q"), (333, "70")], "Visa Purchase 903389 030POSB26091066q 70") == (7000, 0, 0)
    assert at([(100, "099REFEAED"), (170, "00002"), (413, "10"), (501, "95,054.39")]) == (0, 1000, 9505439)
    assert at([(335, "5.00"), (415, "-"), (500, "9.00")]) == (500, 0, 900) and at([(330, "5.00,"), (410, "6.00"), (500, "9.00,")]) == (500, 600, 900)
    assert at([(375, "5.00"), (500, "9.00")], "atm") == (500, 0, 900) and at([(375, "5.00"), (500, "9.00")], "pay") == (0, 500, 900)
    assert at([(10, "5.00"), (20, "x")]) is None and at([(10, "5.00"), (500, "9.00")]) is None and at([]) is None


def plain_lines(tokens):
    """Each token joins the first line whose first token is near enough."""
    lines = []
    for y, x, text in sorted(((y, x, t) for x, y, t in tokens), key=lambda t: (-t[0], t[1], t[2])):
        home = next((line for line in lines if abs(line[0] - y) <= layout.LINE_GAP), None)
        if home is None:
            home = (y, [])
            lines.append(home)
        home[1].append((x, text))
    return [" ".join(t for _, t in sorted(own, key=lambda t: t[0])) for _, own in lines]


def test_lines_of_pages(spark):
    rng = np.random.default_rng(6)
    pages = {(s, p): [(float(rng.integers(0, 500)), float(rng.integers(0, 160)) / 2, f"t{i}") for i in range(n)] for s, p, n in ((1, 1, 60), (1, 2, 1), (2, 1, 150), (2, 3, 12))}
    rows = [(s, p, *t) for (s, p), own in pages.items() for t in own] + [(1, 1, 1.0, 1.0, "  "), (1, 1, 1.0, 1.0, None)]
    found = layout.group_lines(spark.createDataFrame(rows, TOKENS).repartition(3)).orderBy("statement_id", "page", "line").collect()
    for key, own in pages.items():
        assert [r["text"] for r in found if (r["statement_id"], r["page"]) == key] == plain_lines(own)
    assert all(r["text"] == " ".join(t["text"] for t in r["tokens"]) for r in found)


def plain_centers(xs):
    clusters = []
    for x in sorted(xs):
        if clusters and abs(x - clusters[-1][0]) <= layout.COLUMN_GAP:
            c, n = clusters[-1]
            clusters[-1] = ((c * n + x) / (n + 1), n + 1)
        else:
            clusters.append((x, 1))
    return [c for c, _ in clusters][-3:] if len(xs) >= 3 and len(clusters) >= 3 else None


def test_columns_by_headings_or_by_amounts(spark):
    rng = np.random.default_rng(7)
    rows, expected = [], {}
    for s in range(12):
        xs = [float(c + rng.integers(-9, 10)) for c in (60, 200, 335, 415, 501)[s % 4 :] for _ in range(int(rng.integers(1, 9)))]
        rows += [(s, 1, x, 700.0 - 10 * i, "1,234.50" if s % 5 else "12") for i, x in enumerate(xs)] + [(s, 1, 5.0, 700.0 - 10 * i, "05/06/2024") for i in range(4)]
        if plain_centers(xs):
            expected[s] = (*plain_centers(xs), "fallback")
    rows += [(0, 2, 300.0, 800.0, "Debit"), (0, 2, 400.0, 800.0, "CR"), (0, 2, 480.0, 800.0, "Balance (AED)"), (0, 3, 1.0, 800.0, "debit"), (0, 3, 2.0, 800.0, "credit"), (0, 3, 3.0, 800.0, "balance")]
    expected[0] = (300.0, 400.0, 480.0, "header")
    lines = layout.group_lines(spark.createDataFrame(rows, TOKENS))
    found = {r["statement_id"]: tuple(r)[1:] for r in layout.detect_layout(lines).collect()}
    assert found.keys() == expected.keys() and all(np.allclose(found[s][:3], expected[s][:3]) and found[s][3] == expected[s][3] for s in expected)
    placed = layout.anchored_amounts(lines, layout.detect_layout(lines))
    assert placed.where("statement_id = 0").count() > 0 and placed.columns == ["statement_id", "page", "line", "debit", "credit", "balance"]


def test_no_tokens(spark):
    lines = layout.group_lines(spark.createDataFrame([], TOKENS))
    assert lines.count() == 0 and layout.detect_layout(lines).count() == 0 and layout.anchored_amounts(lines, layout.detect_layout(lines)).count() == 0
