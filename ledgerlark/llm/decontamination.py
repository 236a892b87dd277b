"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming look-up, exact weighted similarity.

A document is contaminated by an item if some window of as many words as the item (the whole document if it has fewer)
has a weighted shingle similarity of at least ``similarity`` with it: the sum of the smaller counts of each shingle over
the sum of the larger ones. Words are lower-cased (A-Z); shingles have five words (all words of a shorter item).

Only windows that could reach the similarity by the number of shingles they share with items are fingerprinted. Items of
one length are indexed by 21 blocks of their fingerprints' bits: two fingerprints at most 20 bits apart agree on a block,
so the look-up misses none within the radius. What it finds is compared exactly. A similarity of 0.8 puts fingerprints
9.7 bits apart on average, so a radius that loses about one true window in 20000 is 20 bits, and its blocks have only three
or four bits: the look-up rejects few pairs by itself, the radius rejects most of what the number of shingles lets through.

Items go to the tasks in blocks of bounded size, and the documents are scanned once for each block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from .store import text_bytes
from .text import chunks

RADIUS = 20
BLOCK_BYTES = 8 << 20
SPAN = 1 << 15
_BASE = 0x9FB21C651E98DF25
_EDGES = [64 * k // (RADIUS + 1) for k in range(RADIUS + 2)]


def _majority(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of hashes[start:end] for every pair; starts ascend. Works on spans of about SPAN hashes."""
    if starts[-1] - starts[0] > SPAN:
        cuts = [0, *(np.flatnonzero(np.diff((starts - starts[0]) // SPAN)) + 1).tolist(), len(starts)]
        return np.concatenate([_majority(hashes, starts[a:b], ends[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
    low, high = int(starts.min()), int(ends.max())
    bits = np.unpackbits(hashes[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.concatenate([np.zeros((1, 64), dtype=np.int64), np.cumsum(bits, axis=0, dtype=np.int64)])
    ones = total[ends - low] - total[starts - low]
    return np.packbits(2 * ones > (ends - starts)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


class Items:
    """A block of benchmark items, indexed for look-up."""

    def __init__(self, ids: list[int], texts: list[str], size: int):
        self.ids, self.counts, self.of_length = ids, [], defaultdict(list)
        fingerprints, known = [], defaultdict(set)
        for first, end, words in chunks(pa.array(texts, pa.large_string()), lower=True):
            every, doc = words.shingle_hashes(words.hashes(), size, _BASE)
            for d in range(end - first):
                m = int(words.doc_words[d + 1] - words.doc_words[d])
                if not m:  # an item without words matches nothing
                    self.counts.append(({}, 0))
                    fingerprints.append(0)
                    continue
                shingles = every[np.searchsorted(doc, d) : np.searchsorted(doc, d, side="right")]
                values, counts = np.unique(shingles, return_counts=True)
                self.counts.append((dict(zip(values.tolist(), counts.tolist())), len(shingles)))
                fingerprints.append(int(_majority(shingles, np.array([0]), np.array([len(shingles)]))[0]))
                self.of_length[m].append(first + d)
                known[min(size, m)].update(values.tolist())
        self.fps = np.array(fingerprints, dtype=np.uint64)
        #: shingles of items by shingle size, sorted
        self.known = {k: np.array(sorted(v), dtype=np.uint64) for k, v in known.items()}
        self.shared = {m: np.unique(np.concatenate([np.array(list(self.counts[i][0]), dtype=np.uint64) for i in them])) for m, them in self.of_length.items()}
        self.index = {m: self._blocks(np.array(them)) for m, them in self.of_length.items()}

    def _blocks(self, them: np.ndarray) -> list[dict[int, np.ndarray]]:
        out = []
        for a, z in zip(_EDGES[:-1], _EDGES[1:]):
            values = (self.fps[them] >> np.uint64(a)) & np.uint64((1 << (z - a)) - 1)
            out.append({int(v): them[values == v] for v in np.unique(values)})
        return out

    def near(self, m: int, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(item, places in fps at most RADIUS bits from it) for the items of m words."""
        hits: dict[int, list[np.ndarray]] = defaultdict(list)
        for table, a, z in zip(self.index[m], _EDGES[:-1], _EDGES[1:]):
            values = (fps >> np.uint64(a)) & np.uint64((1 << (z - a)) - 1)
            for v in np.unique(values):
                for item in table.get(int(v), ()):
                    hits[int(item)].append(np.flatnonzero(values == v))
        for item, places in hits.items():
            at = np.unique(np.concatenate(places))
            at = at[np.bitwise_count(fps[at] ^ self.fps[item]) <= RADIUS]
            if len(at):
                yield item, at


def _weighted(item: tuple[dict[int, int], int], window: np.ndarray) -> float:
    values, counts = np.unique(window, return_counts=True)
    have, n = item
    common = sum(min(have.get(v, 0), c) for v, c in zip(values.tolist(), counts.tolist()))
    return common / (n + len(window) - common)


def _matches(column, items: Items, size: int, similarity: float) -> Iterator[tuple[int, int, float, int]]:
    """(place of the document, item, similarity of its best window, first word of that window)."""
    share = 2 * similarity / (1 + similarity) - 1e-9
    for first, _, words in chunks(column, lower=True):
        hashes = words.hashes()
        for k, known in items.known.items():
            shingles, doc = words.shingle_hashes(hashes, k, _BASE)
            place = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
            hit = known[place] == shingles
            if not hit.any():
                continue
            bounds = np.searchsorted(doc, np.arange(len(words.doc_words)))
            for d in np.unique(doc[hit]):
                low, high = int(bounds[d]), int(bounds[d + 1])
                own, met = shingles[low:high], hit[low:high]
                found = np.unique(own[met])
                for m in items.of_length:
                    if min(size, m) != k or not np.isin(found, items.shared[m]).any():
                        continue
                    n = m - k + 1
                    starts = np.arange(max(1, len(own) - n + 1))
                    ends = np.minimum(starts + n, len(own))
                    mine = np.concatenate([[0], np.cumsum(met & np.isin(own, items.shared[m]))])
                    # common shingles are at least similarity * (n + window) / (1 + similarity)
                    enough = mine[ends] - mine[starts] >= share * (n + ends - starts) / 2
                    starts, ends = starts[enough], ends[enough]
                    if not len(starts):
                        continue
                    for item, where in items.near(m, _majority(own, starts, ends)):
                        best = max((_weighted(items.counts[item], own[starts[w] : ends[w]]), -int(starts[w])) for w in where)
                        if best[0] >= similarity:
                            yield first + int(d), items.ids[item], best[0], -best[1]


def _sent(benchmark: DataFrame) -> Iterator[Broadcast]:
    """Broadcasts of (item ids, texts), of about BLOCK_BYTES each."""
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    n = max(1, -(-text_bytes(items)[1] // BLOCK_BYTES))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """doc_id, item_id, similarity (of the best window), first_word: one row for each document and item it holds.

    docs: doc_id, text; benchmark: item_id, text. Null and empty texts hold nothing and are held nowhere; a repeated
    document has its rows repeated; repeated items count once; ties between windows go to the first. A null doc_id stays null.
    """
    docs, out = docs.select("doc_id", "text"), None
    schema = StructType([docs.schema["doc_id"]]).add("item_id", LongType()).add("similarity", DoubleType()).add("first_word", LongType())
    for sent in _sent(benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Items(*sent.value, size)
            for batch in batches:
                found = list(_matches(batch["text"], index, size, similarity)) if index.known else []
                where, item, value, word = zip(*found) if found else ((), (), (), ())
                yield pa.record_batch(
                    [batch["doc_id"].take(pa.array(where, pa.int64())), pa.array(item, pa.int64()), pa.array(value, pa.float64()), pa.array(word, pa.int64())],
                    names=["doc_id", "item_id", "similarity", "first_word"],
                )

        part = docs.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, size: int = 5) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; nothing is shuffled.

    Every row is judged by its own text, whatever its doc_id; null and empty texts hold nothing and stay.
    """
    for sent in _sent(benchmark):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Items(*sent.value, size)
            for batch in batches:
                keep = np.ones(len(batch), dtype=bool)
                if index.known:
                    keep[[x[0] for x in _matches(batch["text"], index, size, similarity)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
