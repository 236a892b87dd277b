"""Repeats and matches of rows against plain loops over one statement."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import matching
from ledgerlark.operators.adjacent import renumber

SCHEMA = "statement_id long, row_idx long, date string, description string, ref_number string, debit long, credit long, balance long, _first string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")][:-1]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)


def random_rows(seed, n, statements=3, dates=("2024-01-01", "2024-01-02", ""), spread=3):
    rng = np.random.default_rng(seed)
    texts = ["atm", "ATM wdl", "atm wdl at the corner", "  ", None, "card fee", "pos shop in the mall of town", "pos  shop", "a b c d e f"]
    refs = [None, "", "R1", "r-1", "R2 x", "A 1 B 2 C"]
    counts, out = [0] * statements, []
    for _ in range(n):
        s = int(rng.integers(statements))
        amount = lambda: None if rng.random() < 0.1 else int(rng.integers(0, 2) * 100)
        balance = None if rng.random() < 0.1 else int(rng.integers(0, spread) * 150)
        out.append((s, counts[s], dates[rng.integers(len(dates))], texts[rng.integers(len(texts))], refs[rng.integers(len(refs))], amount(), amount(), balance))
        counts[s] += 1
    return out


def by_statement(rows):
    return [(s, sorted(own, key=lambda r: r[1])) for s, own in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0])]


def words(t):
    return re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip()


def plain_quality(r):
    text, ref = (r[3] or "").strip(), (r[4] or "").strip()
    return min(len(text), 80) + (min(len(ref), 24) + 6 if ref else 0) + 10 * bool(re.search("[A-Za-z]", ref) and re.search("[0-9]", ref)) - 8 * (len(re.findall(r"\s", ref)) > 2) - 6 * (len(re.split(r"\s+", text)) <= 4)


def number_key(r):
    return ((r[2] or "").strip(), r[5] or 0, r[6] or 0, r[7] or 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_best_of_repeats(spark, seed):
    rows = random_rows(seed, 400)
    expected = []
    for s, own in by_statement(rows):
        kept = {}
        for r in own:
            k = number_key(r)
            if k not in kept:
                kept[k] = (r[1], r)
                continue
            old = kept[k][1]
            a, b = plain_quality(old), plain_quality(r)
            if b > a or (a == b and len(words(r[3])) > len(words(old[3])) and words(old[3]) in words(r[3])):
                kept[k] = (kept[k][0], r)
        expected += [(s, position, r[1]) for position, r in kept.values()]
    found = matching.best_of_repeats(table(spark, rows))
    assert sorted((r["statement_id"], r["position"], r["row_idx"]) for r in found.collect()) == sorted(expected)


@pytest.mark.parametrize("seed, block", [(3, 1 << 16), (4, 5)])
def test_likely_repeats(spark, seed, block):
    rows = random_rows(seed, 500, spread=2)
    rows += [(9, i, "2024-01-01", "same", "R1", 5, 0, 7) for i in range(60)]  # a bucket of copies
    ref = lambda r: re.sub("[^A-Z0-9]", "", (r[4] or "").upper())
    expected = []
    for s, own in by_statement(rows):
        buckets = {}
        for r in own:
            bucket = buckets.setdefault(number_key(r), [])
            for i, k in enumerate(bucket):
                same = ref(k) == ref(r) if ref(k) and ref(r) else words(k[3]) == words(r[3]) if words(k[3]) and words(r[3]) else not any((ref(k), ref(r), words(k[3]), words(r[3])))
                if same:
                    if not ref(k) and ref(r):
                        bucket[i] = r
                    elif not (ref(k) and not ref(r)) and len(words(r[3])) > len(words(k[3])) + 4:
                        bucket[i] = r
                    break
            else:
                bucket.append(r)
        expected += [(s, n, r[1]) for n, r in enumerate(itertools.chain.from_iterable(buckets.values()))]
    found = matching.drop_likely_repeats(table(spark, rows), block)
    assert sorted((r["statement_id"], r["row_idx"], r["kept_row"]) for r in found.collect()) == sorted(expected)


def plain_merge(first, second):
    if not first or not second:
        return [(r, not first) for r in (first or second)]
    day = lambda r: (r[2] or "").strip()
    pool, seen, out, before = list(second), set(), [], None

    def worth(r):
        text, ref, d, c = len((r[3] or "").strip()), len((r[4] or "").strip()), abs(r[5] or 0), abs(r[6] or 0)
        total = min(26, text // 3) + (min(8, ref // 3 + 2) if ref else 0)
        total += 24 if (d > 0 and c == 0) or (c > 0 and d == 0) else 0
        total -= 14 if d > 0 and c > 0 else 30 if d == 0 and c == 0 else 0
        if before is not None and r[7] is not None:
            total += max(-30, 16 - int(abs(before + c - d - r[7]) / 25 + 0.5))
        return total

    def commit(r, secondary):
        nonlocal before
        k = (day(r), r[5] or 0, r[6] or 0, r[7] or 0)
        if k in seen:
            return
        seen.add(k)
        out.append((r, secondary))
        before = r[7] if r[7] is not None else before

    for r in first:
        best = None
        for i, c in enumerate(pool):
            if day(r) and day(c) and day(r) != day(c):
                continue
            off = abs((r[7] or 0) - (c[7] or 0))
            if best is None or off < best[0]:
                best = (off, i)
        if best is None or best[0] > 200:
            commit(r, False)
            continue
        other = pool.pop(best[1])
        commit(*((other, True) if worth(other) > worth(r) else (r, False)))
    for r in pool:
        commit(r, True)
    return out


@pytest.mark.parametrize("seed, dates, spread", [(5, ("2024-01-01", "2024-01-02"), 12), (6, ("2024-01-01", ""), 4), (7, ("2024-01-01",), 2), (8, ("2024-01-01", "2024-01-02", "2024-01-03", None), 40)])
def test_merge_of_two_extractions(spark, seed, dates, spread):
    first, second = random_rows(seed, 240, 4, dates, spread), random_rows(seed + 100, 260, 5, dates, spread)
    first += [(7, 0, "2024-01-01", "only here", None, 1, 0, 5), (7, 1, "2024-01-01", "only here", None, 1, 0, 5)]
    expected = []
    for s in range(8):
        own = lambda rows: sorted((r for r in rows if r[0] == s), key=lambda r: r[1])  # noqa: B023, E731
        expected += [(s, n, secondary, *r[2:]) for n, (r, secondary) in enumerate(plain_merge(own(first), own(second)))]
    found = matching.merge_extractions(table(spark, first), table(spark, second))
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, expected))


def test_matching_of_nothing(spark):
    none, some = table(spark, []), table(spark, [(1, 0, None, None, None, None, None, None)])
    assert matching.best_of_repeats(none).count() == 0 and matching.drop_likely_repeats(none).count() == 0 and matching.merge_extractions(none, none).count() == 0
    assert matching.match_rows(none, some).count() == 0 and matching.match_rows(some, some).collect()[0]["matched"] == 0
    for a, b in ((none, some), (some, none), (some, some)):
        assert matching.merge_extractions(a, b).count() == 1


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_renumbering_in_blocks(spark, block):
    rows = [(s, d, 5 * i + s) for s in range(3) for i in range(20) for d in (None, 1, 2) if (i + s) % 3]
    df = spark.createDataFrame(rows, "statement_id long, day int, row_idx long").withColumn("old", F.col("row_idx")).repartition(4)
    found = {(r["statement_id"], r["day"], r["old"]): r["row_idx"] for r in renumber(df, block, by=("day", "row_idx")).collect()}
    for s in range(3):
        order = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [found[r] for r in order] == list(range(len(order)))
