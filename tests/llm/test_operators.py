"""Every operator on small tables with nulls, empty and long texts, ties, repeated rows, extra columns and no rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlark.llm import (
    decontamination, html_text, near_duplicates, packing, quality, simhash, substrings, token_codes, toxicity, url_filters, vector_search,
)
from ledgerlark.llm.queries import tokenizer_path
from ledgerlark.llm.simhash import close_pairs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = np.random.default_rng(5)
VOCABULARY = ["".join(RNG.choice(list("abcdefghij"), 5)) for _ in range(400)]
DOCS = "doc_id long, text string, n_words long, _extra string"


def text(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


@pytest.fixture(scope="module")
def rows():
    base, shared = text(200, 1), text(60, 2)
    near = base.split()
    near[100] = "changed"
    return [
        (0, base), (1, base), (2, " ".join(near)), (3, text(90, 3) + "\n" + shared + " " + text(40, 4)), (4, shared + "\t" + text(70, 5)),
        (5, None), (6, ""), (7, "  \n "), (8, "One two"), (8, "One two"), (9, text(3000, 6)), (None, "a null id é ü"), (10, shared * 1 + " " + shared),
        (11, "<|endoftext|> odd  spaces\t\n\n end "),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "docs")
    spark.createDataFrame([(i, t, 7, "x") for i, t in rows], DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_substrings_match_brute_force(docs, rows):
    words = [WORD.findall(t or "") for _, t in rows]
    counts = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    expected = []
    for (i, _), w in zip(rows, words):
        gone = {k for s in range(len(w) - 34) if counts[tuple(w[s : s + 35])] > 1 for k in range(s, s + 35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        expected.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    found = substrings.remove_repeats(docs, 35)
    assert found.columns == ["doc_id", "text", "_extra", "n_words", "n_removed"]
    got = [(str(r["doc_id"]), r["n_words"], r["n_removed"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in found.collect()]
    assert sorted(got) == sorted(expected)


def test_substrings_keep_unchanged_texts_and_need_a_long_window(docs, empty):
    kept = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(docs, 50, rejoin=False).collect()}
    assert kept[11] == "<|endoftext|> odd  spaces\t\n\n end " and kept[5] is None
    assert substrings.remove_repeats(empty).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(docs, 21)


def fingerprint(t, size):
    w = WORD.findall(low(t))
    if not w:
        return 0
    n = max(1, len(w) - size + 1)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > n)


def test_simhash_matches_brute_force(docs, rows, empty):
    fps = [fingerprint(t, 3) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and root[i] != root[j]:
                old = root[i]
                root = [root[j] if r == old else r for r in root]
    least = {r: min((i for (i, _), q in zip(rows, root) if q == r and i is not None), default=None) for r in root}
    expected = sorted((str(i), f, str(least[r])) for (i, _), f, r in zip(rows, fps, root))
    assert sorted((str(r["doc_id"]), r["fingerprint"] % 2**64, str(r["component_id"])) for r in simhash.group(docs).collect()) == expected
    assert simhash.group(empty).count() == 0


def test_large_buckets_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", 8)
    rng = np.random.default_rng(1)
    values = {int(rng.integers(2**40)) ^ sum(1 << int(b) for b in rng.choice(63, 2)) for _ in range(40)} | {0b1011 << k for k in range(20)} | set(range(60))
    links = {(r["a"], r["b"]) for r in simhash.links_within(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    from ledgerlark.llm.components import components

    root = {r["node"]: r["root"] for r in components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= 2 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(root.get(v, v) == find(v) for v in values)


def test_bit_sliced_pairs():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 64, (300, 1)).astype(np.uint64)
    bucket = np.sort(rng.integers(0, 9, 300))
    for radius in (0, 1, 2, 3):
        got = {(int(i), int(j)) for a, b in close_pairs(fps, bucket, radius) for i, j in zip(a, b)}
        want = {(i, j) for j in range(300) for i in range(j) if bucket[i] == bucket[j] and int(fps[i, 0] ^ fps[j, 0]).bit_count() <= radius}
        assert got == want


def test_near_duplicates_keep_the_smallest(docs, empty):
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [0, 3, 4, 5, 8, 9, 10, 11, None]))
    assert near_duplicates.keep_one(empty).count() == 0


def grouped_by_hand(pairs_of):
    """The smallest id of each group of texts (id, text) whose five-word shingle sets have a similarity of 0.8 or more."""
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in pairs_of}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in sets})


def edited(base, places):
    words = base.split()
    for k in places:
        words[k] = f"edit{k}"
    return " ".join(words)


def test_near_duplicates_lose_no_pair(spark, tmp_path):
    """Lone pairs at similarity 0.80 to 0.83, of which the fingerprints alone miss about one in six."""
    rows = []
    for k in range(300):
        base = text(204, 1000 + k)
        rows += [(2 * k, base), (2 * k + 1, edited(base, [20, 60, 100, 140][: 3 + k % 2] + [202]))]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    want = grouped_by_hand(rows)
    assert len(want) <= 300
    assert sorted(r["doc_id"] for r in near_duplicates.keep_one(spark.read.parquet(path)).collect()) == want


def family(k):
    """A text, its near copies, and siblings that just fail: each differs from the text in other places."""
    base = text(204, 5000 + k)
    places = [[10 + 3 * j, 50 + 3 * j, 90 + 3 * j, 130 + 3 * j, 170 + 3 * j][: 3 + j % 3] for j in range(8)]
    return [base, *[edited(base, p) for p in places]]


def test_near_duplicates_of_families(spark, tmp_path):
    rows = [(9 * k + j, t) for k in range(60) for j, t in enumerate(family(k)[k % 2 :])]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    assert sorted(r["doc_id"] for r in near_duplicates.keep_one(spark.read.parquet(path)).collect()) == grouped_by_hand(rows)


def test_near_duplicates_are_the_same_at_every_bucket_size(spark, tmp_path, monkeypatch):
    rows = [(9 * k + j, t) for k in range(30) for j, t in enumerate(family(k)[k % 2 :])]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    monkeypatch.setattr(near_duplicates, "LARGE_BUCKET", 2)
    assert sorted(r["doc_id"] for r in near_duplicates.keep_one(spark.read.parquet(path)).collect()) == grouped_by_hand(rows)


def ids_of(rows):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    tokenizer.encode_special_tokens = True
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for _, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_codes_round_trip(spark, docs, rows, empty, tmp_path):
    token_codes.write(docs, str(tmp_path / "a"), tokenizer_path())
    got = token_codes.read_documents(spark, str(tmp_path / "a")).orderBy("start").collect()
    want = sorted((str(i), len(x) + 1, crc([*x, 0])) for (i, _), x in zip(rows, ids_of(rows)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == [sum(r["n_tokens"] for r in got[:k]) for k in range(len(got))]
    assert [r["doc_id"] for r in got][1:] == sorted(i for i, _ in rows if i is not None) and got[0]["doc_id"] is None
    token_codes.write(empty, str(tmp_path / "b"), tokenizer_path())
    assert token_codes.read_documents(spark, str(tmp_path / "b")).count() == 0


def test_token_codes_random_access():
    ids = np.random.default_rng(2).choice([0, 5, 255, 256, 70000, 2**24 + 3, 2**32 - 1], 5000).astype(np.uint32)
    block = token_codes.Block(*token_codes.encode(ids))
    at = np.random.default_rng(3).integers(0, 5000, 700)
    assert (block.get(at) == ids[at]).all()
    for a, b in ((0, 5000), (511, 513), (7, 7), (1234, 4321)):
        assert (block.range(a, b) == ids[a:b]).all()


def best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(capacity - n)
    return sorted(bins)


def test_packing(docs, rows, empty):
    got = packing.pack(docs, tokenizer_path(), capacity=64).collect()
    ids = [[*x, 2] for x in ids_of(rows)]
    want = []
    for (i, _), x in zip(rows, ids):
        cuts = [0, *range((len(x) - 1) % 64 + 1, len(x) + 1, 64)]
        want += [(str(i), k, a, b - a, crc(x[a:b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(64 - e for e in ends.values()) == best_fit([w[3] for w in want], 64)
    assert packing.pack(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([7, 20, 37, 128]))
    lengths = rng.integers(1, capacity + 1, rng.integers(0, 150)).tolist()
    used = Counter()
    for length, low, high, per, first, at in packing.plan(dict(Counter(lengths)), capacity):
        for r in range(low, high):
            used[first + (r - low) // per] += length
    assert sorted(capacity - n for n in used.values()) == best_fit(lengths, capacity)


def test_decontamination(spark, empty):
    item = text(40, 11)
    edited = item.split()
    edited[2] = "edited"
    half = " ".join(item.split()[:20] + text(20, 12).split())
    docs = spark.createDataFrame(
        [(1, text(50, 13) + " " + item.upper() + " " + text(9, 14)), (2, text(30, 15) + "\n" + " ".join(edited)), (3, half), (4, None), (5, ""), (6, text(500, 16)), (7, item), (7, item), (8, "two words"), (9, item + " " + item)],
        "doc_id long, text string",
    )
    benchmark = spark.createDataFrame([(100, item), (101, None), (102, ""), (103, "Two words"), (104, text(45, 17)), (100, item)], "item_id long, text string")
    found = decontamination.contaminated(docs, benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(1, 100), (2, 100), (7, 100), (7, 100), (8, 103), (9, 100)]
    assert {r["first_word"] for r in found if r["doc_id"] == 1} == {50}
    assert decontamination.contaminated(empty, benchmark).count() == 0
    named = docs.withColumn("item_id", F.lit(1)).union(spark.createDataFrame([(None, item, 1), (1, "clean words", 1)], "doc_id long, text string, item_id int"))
    kept = decontamination.clean(named, benchmark)
    assert kept.columns == named.columns and sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([("1", "clean words"), ("3", half), ("4", None), ("5", ""), ("6", text(500, 16))], key=lambda x: (x[0], x[1] or ""))
    assert decontamination.contaminated(docs, benchmark.limit(0)).count() == 0


def test_vector_search(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, rng.integers(-500, 500, 12).tolist()) for i in range(300)]
    vectors += [(300, vectors[0][1]), (301, vectors[0][1]), (302, None), (303, []), (None, vectors[0][1]), (304, [1, 2]), (304, [1, 2]), (50, vectors[50][1]), (100, [3] * 12)]
    vectors += [(400 + i, vectors[7][1]) for i in range(30)] + [(2000 - i, (np.array(vectors[7][1]) + i % 2).tolist()) for i in range(20)]
    table = [(r, *x) for r, x in enumerate(vectors)]
    index = vector_search.build(spark.createDataFrame(vectors, "vec_id long, v array<bigint>").repartition(3))
    got = vector_search.search(index, index.rows.where("vec_id % 50 = 0 or vec_id = 304"), k=7).collect()
    want = []
    for r, q, v in table:
        if q is not None and v and (q % 50 == 0 or q == 304):
            best = sorted((-int(np.dot(v, w)), i) for s, i, w in table if s != r and i is not None and w and len(w) == len(v))[:7]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    none = vector_search.build(spark.createDataFrame([], "vec_id long, v array<bigint>"))
    assert vector_search.search(none, none.rows).count() == 0


def test_url_filters(spark):
    captures = spark.createDataFrame(
        [(1, "http://a.b.com/x/y", "2024-01-05", "z"), (2, "https://u@B.com:80/x?q", "2024-02-05", "z"), (3, None, "2024-01-05", "z"), (4, "nonsense", "2024-01-05", "z"),
         (5, "http://bb.com/", "2024-01-05", "z"), (6, "http://b.com/xy", "2024-03-05", "z"), (6, "http://b.com/xy", "2024-03-05", "z"), (7, "http://b.com/x/", None, "z")],
        "id int, url string, day string, host string",
    ).withColumn("day", F.to_date("day"))
    entries = spark.createDataFrame(
        [("block", "domain", "b.com", "add", "2024-01-01"), ("block", "domain", "b.com", "remove", "2024-02-01"), ("block", "domain", "b.com", "add", "2024-03-01"),
         ("allow", "prefix", "b.com/x", "add", "2024-02-01"), ("block", "domain", None, "add", "2024-01-01"), ("block", "domain", "b.com", "add", "2024-01-02")],
        "list string, kind string, pattern string, action string, day string",
    ).withColumn("day", F.to_date("day"))
    got = sorted((r["id"], r["verdict"], r["n_active"], r["host"]) for r in url_filters.judge(captures, entries).collect())
    want = [(1, "block", 1, "a.b.com"), (2, "allow", 1, "b.com"), (3, "none", 0, ""), (4, "none", 0, ""), (5, "none", 0, "bb.com"), (6, "block", 1, "b.com"), (6, "block", 1, "b.com"), (7, "none", 0, "b.com")]
    assert got == want
    assert url_filters.judge(captures, entries.limit(0)).count() == 8
    assert url_filters.judge(captures.limit(0), entries).count() == 0


def test_url_filters_beyond_the_broadcast_bound(spark, monkeypatch):
    captures = spark.createDataFrame([(i, f"http://h{i % 3}.com/a") for i in range(50)], "id int, url string").withColumn("day", F.to_date(F.lit("2024-01-05")))
    entries = spark.createDataFrame([("block", "domain", "h1.com", "add")], "list string, kind string, pattern string, action string").withColumn("day", F.to_date(F.lit("2024-01-01")))
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", 0)
    assert url_filters.judge(captures, entries).where("verdict = 'block'").count() == 17


ARTICLE = "<html><head><title>T</title></head><body>{}<nav>menu</nav><article><h1>A &amp; B</h1><p class='ad'>buy<p>One  <b>tw</b>o<br>three</article><footer>f</footer>"


def test_html_text(spark):
    plain = "<body><div>Site name</div><p>{}</p><div>All rights reserved</div></body>"
    pages = spark.createDataFrame(
        [(1, "http://h.com/a/1", ARTICLE.format(""), 3), (2, "http://h.com/b/1", plain.format("first"), 3), (3, "http://h.com/b/2", plain.format("second"), 3), (3, "http://h.com/b/2", plain.format("second"), 3),
         (4, None, plain.format("x"), 3), (5, "http://g.com/", None, 3), (6, "http://g.com/", "", 3), (7, "http://h.com/a/2", ARTICLE.format(""), 3)],
        "page_id long, url string, html string, n_chars int",
    )
    found = html_text.extract(pages)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in found.collect())
    texts = [(1, "A & B One two three"), (2, "first"), (3, "second"), (3, "second"), (4, "Site name x All rights reserved"), (5, ""), (6, ""), (7, "A & B One two three")]
    assert got == [(i, t, len(t)) for i, t in texts]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_differencing_decides_outside_articles(spark):
    """Unmarked text beside an article goes if the nearest page has it too, and stays if not; the article's own lines stay."""
    head = "<div>The Daily Page</div><div>{}</div>"
    pages = [(k, f"http://h.com/news/{k}", ARTICLE.format(head.format(f"Standfirst {k}"))) for k in range(5)]
    pages.append((9, "http://h.com/shop/9", "<div>Shop</div><p>goods</p>"))
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Standfirst {k} A & B One two three" for k in range(5)} | {9: "Shop goods"}


def lcs_by_hand(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_html_text_matches_brute_force(spark, monkeypatch):
    """Pages of unmarked lines over several hosts and folders, dealt over many parts: what is left is the page without what it shares with its nearest page."""
    monkeypatch.setattr(html_text, "PART_ROWS", 7)
    rng = np.random.default_rng(31)
    pages = []
    for k in range(80):
        where = f"{'ab'[k % 2]}.com", f"/{'xyz'[k // 2 % 3]}/{k:03d}"
        menu = [f"menu {where[0]} {i}" for i in range(4)] + [f"folder {where[1][1]} {i}" for i in range(3)]
        body = [text(20, 4000 + k) for _ in range(1)] + [text(15, 6000 + 2 * k), text(15, 6001 + 2 * k)]
        page_lines = menu[: int(rng.integers(2, 8))] + body
        pages.append((k, f"http://{where[0]}{where[1]}", "".join(f"<p>{x}</p>" for x in page_lines), where, page_lines))
    pages.append((80, "http://a.com/x/000", pages[0][2], ("a.com", "/x/000"), pages[0][4]))
    found = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()}
    order = sorted({(p[3], tuple(p[4])) for p in pages})
    for k, _, _, where, own in pages:
        at, beside = order.index((where, tuple(own))), []
        for side, other in ((0, at - 1), (1, at + 1)):
            if 0 <= other < len(order) and order[other][0][0] == where[0]:
                steps = [(x, y) for x, y in zip(where[1].split("/"), order[other][0][1].split("/"))]
                beside.append((-next((i for i, (x, y) in enumerate(steps) if x != y), len(steps)), side, list(order[other][1])))
        near = min(beside)[2]
        gone = [x for x in own if x in near]
        assert lcs_by_hand(own, near) == len(gone)
        assert found[k] == " ".join(x for x in own if x not in gone)


def test_markup_of_odd_pages():
    def kept(source):
        return " ".join(line for line, zone in html_text.lines(source) if zone)

    assert kept("<article><p title=it's>first text</p><p>second's</p></article>") == "first text second's"
    assert kept("<article><section id='related-work'>a</section><p class='social-history'>b</p><div class='share-price'>c</div><div class='comments'>d</div></article>") == "a b c"
    assert kept("<p>x <math><mi>y</mi></math></p><!-- open <p>z") == "x y"
    assert kept("<p>a</p><script>var x = '<p>'</script>b<style>c") == "a b"
    assert kept("a < b <p>c<br") == "a < b c" and kept(None) == "" and kept("<a href='x>y'>z</a>") == "z"
    for odd in ("<a ", "<![CDATA[", "<a b='", "<!--", "<script ", "<a b=\">", "</", "<p ='\">"):
        kept(odd * 200_000)


def test_longest_common_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(0, 14)).tolist(), rng.integers(0, 5, rng.integers(0, 14)).tolist()
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        got = html_text.common(a, b)
        it = iter(b)
        assert len(got) == best[-1][-1] and got == sorted(set(got)) and all(a[k] in it for k in got)


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, docs, empty, module, label):
    rng = np.random.default_rng(9)
    marked = []
    for i in range(240):
        words = rng.choice(VOCABULARY, 60).tolist()
        if i % 3 == 0:
            words[10::6] = rng.choice(["zzqvile", "xxqfoul", "wwqnasty"], len(words[10::6])).tolist()
        marked.append((1000 + i, " ".join(words), int(i % 3 == 0)))
    table = spark.createDataFrame(marked, f"doc_id long, text string, {label} int")
    held_out = F.col("doc_id") % 4 == 0
    model = module.fit(table.select("doc_id", "text"), table.select("doc_id", label), held_out)
    scores = module.score(table.select("doc_id", "text", F.lit(1).alias(label + "s")), model).join(table.select("doc_id", F.col(label).alias("y")), "doc_id").collect()
    name = "toxicity" if module is toxicity else "quality"
    right = [(r[name] >= 0.5) == (r["y"] == 1) for r in scores if r["doc_id"] % 4 == 0]
    assert np.mean(right) > 0.9
    every = module.score(docs, model).collect()
    assert len(every) == docs.count() and all(0 <= r[name] <= 1 for r in every)
    assert module.score(empty, model).count() == 0
    none = module.fit(table.select("doc_id", "text"), table.select("doc_id", label).limit(0))
    assert all(r[name] == 0.5 for r in module.score(docs, none).collect())


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    kept = packed.select("doc_id").distinct().count()
    assert 0.5 * docs.count() < kept <= docs.count()
    assert len(corpus_pipeline.STAGES) == 5


def test_spacing_check_agrees_with_its_pattern():
    import itertools

    from ledgerlark.llm.tokens import _ODD_SPACE, odd_spacing

    for n in range(1, 6):
        for x in map("".join, itertools.product(" \n\t\u3000a", repeat=n)):
            assert odd_spacing(x) == bool(_ODD_SPACE.search(x)), repr(x)


def test_queries_encode_special_tokens_by_the_file(spark, tmp_path):
    import corpus_pipeline
    from ledgerlark.llm import queries

    texts = ["see <|endoftext|> here", "plain words here", "a<|endoftext|>", "two\nlines <|endoftext|>\nend"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    got = queries.op3_token_codes(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == [(i, len(x) + 1, crc([*x, 0])) for i, x in enumerate(ids)]
    for packed in (queries.op5_packing(spark, str(tmp_path)), corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "")):
        assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in packed.collect()) == [(i, len(x) + 1, crc([*x, 2])) for i, x in enumerate(ids)]


def test_dictionary_windows_cover_whole_texts():
    import pyarrow as pa

    raw = "".join(chr(97 + k) * quality.WINDOW_BYTES for k in range(11)) + "zz"
    (out,) = quality._windows(iter([pa.record_batch([pa.array([raw, None, ""]), pa.array([1, 0, 0], pa.int32())], names=["text", "y"])]))
    assert b"".join(out["w"].to_pylist()).decode() == raw and out["y"].to_pylist() == [1] * 12


def test_window_lengths_are_those_of_plain_compression():
    import zstandard

    from ledgerlark.llm.compression import compressor, trained, window_lengths

    samples = [text(60, k).encode() for k in range(40)]
    dictionary = trained(samples, 4096, k=64, d=8)
    raw = zstandard.ZstdCompressionDict(dictionary)
    assert raw.dict_id() > 0 and trained([], 4096, k=64, d=8) == b""
    buf = b"".join(samples)
    sizes = np.array([len(x) for x in samples])
    got = window_lengths(compressor(dictionary), buf, np.cumsum(sizes) - sizes, sizes)
    # one window at a time, the dictionary as it was trained; with the same parameters, since zstandard adapts a bare level to each window's size
    params = zstandard.ZstdCompressionParameters.from_level(3, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    frames = [zstandard.ZstdCompressor(compression_params=params, dict_data=raw).compress(x) for x in samples]
    assert got.tolist() == [len(x) for x in frames]
    back = zstandard.ZstdDecompressor(dict_data=raw, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    assert [back.decompress(x, max_output_size=1 << 16) for x in frames] == samples


def test_word_and_window_hashes_tell_thue_morse_words_apart():
    from ledgerlark.llm.text import window_hashes, word_hashes

    bits = [bin(k).count("1") & 1 for k in range(4096)]
    one, two = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    buf = np.frombuffer((one + two + "abababab" + "ab").encode(), dtype=np.uint8)
    starts, ends = np.array([0, 4096, 8192, 8192, 8192]), np.array([4096, 8192, 8194, 8200, 8202])
    assert len(set(word_hashes(buf, starts, ends, 1).tolist())) == 5
    for n in (2, 35, 64, 2048):
        values = np.array([7, 9], dtype=np.uint64)[np.array(bits)]
        found = {}
        for i, h in enumerate(window_hashes(values, n, 3).tolist()):
            assert found.setdefault(h, values[i : i + n].tobytes()) == values[i : i + n].tobytes()
        assert len(found) == len({values[i : i + n].tobytes() for i in range(len(values) - n + 1)})


def test_decontamination_matches_brute_force(spark):
    rng = np.random.default_rng(21)
    items = [(k, text(int(rng.integers(1, 60)), 300 + k)) for k in range(12)] + [(50, " ".join(["same"] * 9)), (51, "three little words")]
    docs = []
    for k in range(60):
        words = items[k % len(items)][1].split()
        for at in rng.integers(0, len(words), k % 4):
            words[at] = f"new{at}"
        docs.append((k, " ".join([*text(int(rng.integers(0, 30)), 700 + k).split(), *words, *text(int(rng.integers(0, 30)), 900 + k).split()])))
    docs.append((60, " ".join(["same"] * 40)))

    def shingles(words, size):
        return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))

    want = []
    for d, t in docs:
        w = t.split()
        for i, x in items:
            own = x.split()
            size = min(5, len(own))
            item, best = shingles(own, size), 0
            for s in range(max(1, len(w) - len(own) + 1)):
                window = shingles(w[s : s + len(own)], size)
                both = sum((item & window).values())
                best = max(best, both / sum((item | window).values()))
            if best >= 0.8:
                want.append((d, i, round(best, 9)))
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in found.collect()) == sorted(want) and len(want) > 20


CLASH = {"_g": 1, "_row": 2, "_n": 3, "_id": 4, "_key": 5, "_bucket": 6, "fp": 7, "node": 8, "count": 9}


def test_clashing_columns_stay(spark, tmp_path):
    table = spark.createDataFrame([(1, text(80, 1)), (2, text(80, 1)), (3, None)], "doc_id long, text string").withColumns({c: F.lit(v) for c, v in CLASH.items()})
    columns = table.columns
    assert near_duplicates.keep_one(table).columns == columns
    assert {tuple(r[c] for c in CLASH) for r in near_duplicates.keep_one(table).collect()} == {tuple(CLASH.values())}
    kept = substrings.remove_repeats(table).collect()
    assert {tuple(r[c] for c in CLASH) for r in kept} == {tuple(CLASH.values())} and sum(r["n_removed"] for r in kept) == 160
    assert simhash.group(table).count() == 3
    captures = table.withColumns({"url": F.lit("http://a.com/x"), "day": F.to_date(F.lit("2024-01-05"))})
    entries = spark.createDataFrame([("block", "domain", "a.com", "add"), ("block", "domain", "", "add")], "list string, kind string, pattern string, action string").withColumn("day", F.to_date(F.lit("2024-01-01")))
    judged = url_filters.judge(captures, entries)
    assert {(r["verdict"], r["n_active"], *[r[c] for c in CLASH]) for r in judged.collect()} == {("block", 1, *CLASH.values())}
    pages = table.withColumns({"url": F.lit("http://a.com/x"), "html": F.lit("<p>one</p>")})
    assert {tuple(r[c] for c in CLASH) for r in html_text.extract(pages).collect()} == {tuple(CLASH.values())}
