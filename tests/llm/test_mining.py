"""Hard negatives, importance resampling and language identification against brute force."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import hard_negatives, language, resampling

VECTORS = "vec_id long, label long, v array<bigint>, row string, score double"
DOCS = "doc_id long, text string, lang string, score string, rank int, _x int"


def mined(rows, anchor, positives=5, negatives=3):
    """(anchor, positive, rank, negative, scores) by sorting all rows."""
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[2]]
    out = []
    for a in (x for x in enumerate(rows) if anchor(x[1][0])):
        scored = sorted((-sum(p * q for p, q in zip(a[1][2], r[2])), r[0], i) for i, r in enumerate(rows) if i != a[0] and len(r[2]) == len(a[1][2]))
        same = [s for s in scored if rows[s[2]][1] == a[1][1]][:positives]
        other = [s for s in scored if rows[s[2]][1] != a[1][1]]
        for p in same:
            inside = [s for s in other if 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:negatives]
            out += [(a[1][0], p[1], k + 1, s[1], -p[0], -s[0]) for k, s in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes, scores", [(1 << 20, 1 << 20), (600, 64)])
def test_hard_negatives_match_brute_force(spark, monkeypatch, block_bytes, scores):
    monkeypatch.setattr(hard_negatives, "ANCHOR_BYTES", block_bytes)
    monkeypatch.setattr(hard_negatives, "SCORES", scores)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), rng.integers(-4, 9, 4).tolist()) for i in range(150)]
    rows += [(7, 0, [5, 5, 5, 5])] * 20 + [(200 + i, i % 2, [6, 1, 1, 1]) for i in range(60)]  # repeated ids, equal vectors
    rows += [(None, 0, [1, 1, 1, 1]), (300, None, [1, 1, 1, 1]), (310, 1, None), (320, 1, [1, None, 1, 1]), (330, 1, []), (331, 2, []), (332, 1, []), (340, 1, [3, 3])]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], VECTORS).repartition(3)
    found = sorted(tuple(r) for r in hard_negatives.mine(df, anchors=F.col("vec_id") % 10 == 0).collect())
    expected = mined(rows, lambda i: i % 10 == 0)
    assert found == expected and len(expected) > 100


def test_scores_beyond_doubles_are_exact(spark):
    big = 94_906_267  # its square is above 2^53
    rows = [(0, 1, [big, 1]), (1, 1, [big, 1]), (2, 0, [big // 2, 1]), (3, 0, [big // 2, 2]), (4, 0, [0, 0])]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], VECTORS)
    assert sorted(tuple(r) for r in hard_negatives.mine(df, anchors=F.col("vec_id") == 0).collect()) == mined(rows, lambda i: i == 0)


def test_no_vectors_and_no_anchors(spark):
    empty = spark.createDataFrame([], VECTORS)
    some = spark.createDataFrame([(1, 1, [1, 2], "x", 0.5)], VECTORS)
    for df, anchors in ((empty, F.lit(True)), (some, F.lit(False)), (some, F.lit(None).cast("boolean")), (some, F.lit(True))):
        assert hard_negatives.mine(df, anchors=anchors).collect() == []


def features(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [zlib.crc32(f.encode()) % 50 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]], len(words)


def resampled(docs, target, percent=25, least=20):
    own = [features(t) for _, t in docs]
    s, t = [0] * 50, [0] * 50
    for b in itertools.chain.from_iterable(f for f, _ in own):
        s[b] += 1
    for b in itertools.chain.from_iterable(features(x)[0] for x in target):
        t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + 50) / ((s[b] + 1) * (sum(t) + 50)))) for b in range(50)]
    rows = []
    for (i, _), (f, n) in zip(docs, own):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    able = sorted((r for r in rows if r[4] >= least and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    drawn = [(*r[:4], k + 1) for k, r in enumerate(able[: percent * len(able) // 100])]
    return drawn + [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in rows if r[4] < least or r[0] is None]


def ordered(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("range_rows", [1 << 14, 7])
def test_resampling_matches_brute_force(spark, monkeypatch, range_rows):
    monkeypatch.setattr(resampling, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(resampling.draw, "__defaults__", (25, 4, range_rows))
    rng = np.random.default_rng(8)
    words = ["Alpha", "beta", "Ωmega", "ÄÖ", "x1", "42", "z" * 47, "z" * 48, "z" * 49, "y" * 300, "a_b", "é-è", "　", "​"]
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60))))) for i in range(150)]
    docs += [(500, "alpha beta " * 30)] * 9 + [(501, None), (502, ""), (503, " .. !"), (None, "beta " * 40), (504, "w " * 5000), (505, "q" * 100_000), (506, "one\x00two\x7fthree")]
    target = ["alpha Ωmega " * 10, None, ""]
    df = spark.createDataFrame([(i, t, "x", "y", 3, 1) for i, t in docs], DOCS).repartition(4)
    other = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    found = resampling.resample(df, other, buckets=50)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert ordered(tuple(r) for r in found.collect()) == ordered(resampled(docs, target))


def test_resampling_of_nothing(spark):
    empty, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", None, None, None, None)], DOCS)
    assert resampling.resample(empty, empty).collect() == [] and resampling.resample(empty, one).collect() == []
    assert [r["rank"] for r in resampling.resample(one, empty).collect()] == [None]


def test_merge_of_many_runs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        runs = [sorted((int(x),) for x in rng.integers(0, 40, rng.integers(1, 60))) for _ in range(rng.integers(1, 12))]
        blocks = sorted(((keys[i : i + 5], r, i) for r, keys in enumerate(runs) for i in range(0, len(keys), 5)), key=lambda b: (b[0][0], b[1], b[2]))
        merge, n = resampling.Merge((r, keys) for keys, r, _ in blocks), int(rng.integers(0, 80))
        everything = sorted(itertools.chain.from_iterable(runs))
        assert list(merge.take(n)) == everything[:n]
        assert sorted(merge.rest()) == everything[n:]


def test_ranges_stop_at_the_draw():
    assert resampling.ranges([(5, 3), (9, 2), (7, 4), (1, 100)], 7, rows=3) == [(7, 0), (5, 6)]
    assert resampling.ranges([(5, 3)], 0) == [] and resampling.ranges([], 0) == []


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(2)
    parts = {"aa": ["the", "ing", "tion", "and"], "bb": ["ung", "sch", "keit", "der"], "cc": ["при", "вет", "мир"], "dd": ["漢字", "中文", "語"]}
    rows = [(i, " ".join("".join(rng.choice(p, 2)) for _ in range(40)), k) for k, p in parts.items() for i in range(20)]
    return language.fit(spark.createDataFrame([*rows, (1, None, "zz"), (2, "text", None)], "doc_id long, text string, lang string"))


def test_language_of_odd_texts(spark, model):
    assert model.languages == ("aa", "bb", "cc", "dd")
    texts = ["theing tionand", "UNGSCH keitder!", "привет 12 мир", "漢字中文" * 500, None, "", "123 ..!", "́́", "θεος", "a" * 100_000, "theing " * 40 + "schung " * 60, "İING the\x00tion"]
    df = spark.createDataFrame([(i, t, "x", "old", 1, 2) for i, t in enumerate(texts)], DOCS).repartition(2)
    found = language.identify(df, model)
    assert found.columns == ["doc_id", "text", "lang", "rank", "_x", "lang_pred", "score"]
    got = {r["doc_id"]: r for r in found.collect()}
    assert [got[i]["lang_pred"] for i in range(8)] == ["aa", "bb", "cc", "dd", "und", "und", "und", "und"]
    assert got[4]["score"] == 0.0 and got[0]["score"] == 1.0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[8]["lang_pred"] in model.languages and got[10]["lang_pred"] == "bb" and abs(got[10]["score"] - 0.6) < 0.02
    parts = [(r["lang"], r["start"], r["end"]) for r in language.spans(df.where("doc_id = 10"), model).orderBy("span").collect()]
    assert parts == [("aa", 0, 279), ("bb", 280, 699)]
    assert language.spans(df.where("doc_id in (4, 5, 6, 7)"), model).collect() == []


def test_words_are_runs_of_letters_of_one_script():
    import pyarrow as pa

    texts = ["Ab1cd привет", "x" * 50, "", "été ́", "漢字abc", "z", "y"]
    words = language.Words(pa.array(texts, pa.large_string()))
    found = [["".join(map(chr, words.points[s:e])) for s, e in zip(words.starts[a:b], words.ends[a:b])] for a, b in zip(words.at[:-1], words.at[1:])]
    assert found == [["ab", "cd", "привет"], ["x" * 24, "x" * 24, "xx"], [], ["été"], ["漢字", "abc"], ["z"], ["y"]]


def test_labels_are_the_best_of_all_labellings(model, monkeypatch):
    rng = np.random.default_rng(4)

    class Some:
        pass

    for _ in range(200):
        sizes = rng.integers(0, 7, 3)
        words = Some()
        words.at = np.concatenate([[0], np.cumsum(sizes)])
        score = rng.integers(-14, 1, (int(sizes.sum()), 3)).astype(float)
        monkeypatch.setattr(language, "_scores", lambda *_: score)
        three = language.Model(("a", "b", "c"), None, None)
        label = language.label_words(words, three, penalty=4.5)
        for a, b in zip(words.at[:-1], words.at[1:]):
            worth = lambda path: sum(score[a + t, k] for t, k in enumerate(path)) - 4.5 * sum(x != y for x, y in zip(path, path[1:]))
            best = max((worth(p) for p in itertools.product(range(3), repeat=int(b - a))), default=0)
            assert worth(label[a:b].tolist()) == best


def test_no_labelled_rows(spark):
    df = spark.createDataFrame([(1, "some text", None, None, None, None)], DOCS)
    nothing = language.fit(df)
    assert nothing.languages == () and language.spans(df, nothing).collect() == []
    assert [(r["lang_pred"], r["score"]) for r in language.identify(df, nothing).collect()] == [("und", 0.0)]
    assert language.identify(df.limit(0), nothing).collect() == []
    one = language.fit(df.withColumn("lang", F.lit("en")), held_out=F.lit(None).cast("boolean"))
    assert [(r["lang_pred"], r["score"]) for r in language.identify(df, one).collect()] == [("en", 1.0)]


def test_held_out_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = language.identify(docs, language.fit(docs, held_out)).where(held_out)
    assert found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
