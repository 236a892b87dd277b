"""Importance resampling towards a target distribution: bucketed word features, a score for each document, an exact draw.

A document's weight is the floored mean, over its features (runs of one and of two words), of a gain that its feature's
bucket has: how much more frequent the bucket is in the target than in the corpus. The gains are one array of ``buckets``
integers, all that tasks receive. A seeded Gumbel value is added, and the highest scores are drawn without replacement.

The draw is an external merge. Each task sorts its eligible rows into runs of blocks; the exact counts of all score values
(integers of a narrow range) cut the order into ranges of bounded size, and tell which ranges lie beyond the draw; each
remaining range merges its runs by a tournament tree, reading a block when the merge reaches its first row, and stops at
the exact draw count. Ranks are the range's offset plus the place in the merge.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .store import cut
from .text import as_strings

CHUNK_BYTES = 1 << 20
#: Longer words take zlib's own loop.
LONG_WORD = 48
BLOCK_ROWS, RANGE_ROWS, MOST_RANGES = 4096, 1 << 14, 4096

_BYTES = np.arange(256)
_WORD = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))


def _step_table() -> np.ndarray:
    """The 256 remainders of CRC-32's reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_STEP = _step_table()


def _shift_tables(most: int) -> np.ndarray:
    """tables[n, j, b]: what byte b at place j of a checksum becomes when n bytes follow (the part that doesn't depend on them)."""
    tables = np.zeros((most + 1, 4, 256), dtype=np.uint32)
    for j in range(4):
        tables[0, j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
    for n in range(most):
        tables[n + 1] = _STEP[tables[n] & 0xFF] ^ (tables[n] >> np.uint32(8))
    return tables


_SHIFT = _shift_tables(LONG_WORD)


def _crc_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of buf[s:e] for every pair."""
    size, state = ends - starts, np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    long = np.flatnonzero(size > LONG_WORD)
    at, k = np.flatnonzero(size <= LONG_WORD), 0
    at = at[size[at] > 0]
    while len(at):
        own = state[at]
        state[at] = _STEP[(own ^ buf[starts[at] + k]) & 0xFF] ^ (own >> np.uint32(8))
        k += 1
        at = at[size[at] > k]
    state ^= np.uint32(0xFFFFFFFF)
    for i in long.tolist():
        state[i] = zlib.crc32(buf[starts[i] : ends[i]])
    return state


def _crc_pairs(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, crc: np.ndarray, left: np.ndarray) -> np.ndarray:
    """CRC-32 of word i, a space and word i + 1, for every i in left; crc: those of the words."""
    own = ~crc[left]
    spaced = ~(_STEP[(own ^ np.uint32(0x20)) & 0xFF] ^ (own >> np.uint32(8)))
    right = left + 1
    size = ends[right] - starts[right]
    n = np.minimum(size, LONG_WORD)
    out = crc[right].copy()
    for j in range(4):
        out ^= _SHIFT[n, j, (spaced >> np.uint32(8 * j)) & 0xFF]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = zlib.crc32(buf[starts[right[i]] : ends[right[i]]], int(spaced[i]))
    return out


class Features:
    """The words of some consecutive texts and the buckets of their features."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, buckets: int):
        """buf: lower-cased bytes of the texts, one after another; bounds: n + 1 offsets of the texts in it."""
        word = _WORD[buf]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        inner = bounds[(bounds > 0) & (bounds < len(buf))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words[at[d]:at[d + 1]] belong to text d
        self.at = np.searchsorted(starts, bounds)
        crc = _crc_words(buf, starts, ends)
        follows = np.ones(len(starts), dtype=bool)  # the next word is of the same text
        ends_of = self.at[1:][np.diff(self.at) > 0] - 1
        follows[ends_of] = False
        self.left = np.flatnonzero(follows)
        self.one = (crc % np.uint32(buckets)).astype(np.int64)
        self.two = (_crc_pairs(buf, starts, ends, crc, self.left) % np.uint32(buckets)).astype(np.int64)

    def counts(self, buckets: int) -> np.ndarray:
        return np.bincount(self.one, minlength=buckets) + np.bincount(self.two, minlength=buckets)

    def weights(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: words, features, floored mean gain (0 without features)."""
        total = gains[self.one]
        total[self.left] += gains[self.two]
        sums = np.concatenate([[0], np.cumsum(total)])
        words = np.diff(self.at)
        features = np.maximum(2 * words - 1, 0)
        return words, features, (sums[self.at[1:]] - sums[self.at[:-1]]) // np.maximum(features, 1)


def _chunks(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, Features]]:
    """(first, end, features) for runs of texts of about CHUNK_BYTES; one long text may exceed it. A null text is empty."""
    texts = as_strings(column)
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, side="right")) - 1))
        buf = data[offsets[first] : offsets[end]]
        buf = buf + ((buf >= 0x41) & (buf <= 0x5A)) * np.uint8(32)
        yield first, end, Features(buf, np.asarray(offsets[first : end + 1] - offsets[first]), buckets)
        first = end


def bucket_counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, found in _chunks(batch["text"], buckets):
                total += found.counts(buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = 1000) -> np.ndarray:
    """floor(scale * ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, in doubles."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(scale * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """All columns of docs but the text, with n_words, n_features and weight (long); columns of these names are replaced."""
    names = ["n_words", "n_features", "weight"]
    docs = docs.drop(*names)
    schema = StructType([f for f in docs.schema.fields if f.name != "text"])
    for name in names:
        schema = schema.add(name, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [found.weights(gain) for _, _, found in _chunks(batch["text"], len(gain))]
            own = [np.concatenate(x).astype(np.int64) for x in zip(*parts)] if parts else [np.zeros(0, dtype=np.int64)] * 3
            rest = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.record_batch([*(batch.column(i) for i in rest), *map(pa.array, own)], names=[*(batch.schema.names[i] for i in rest), *names])

    return docs.mapInArrow(run, schema)


def gumbel(seed: int, scale: int = 1000) -> Column:
    """floor(-scale * ln(-ln((h + 0.5) / 2^32))), h: the first 8 hex digits of sha256('<seed>:<doc_id>'); null for a null id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


class Tournament:
    """The run with the least head among many: a complete binary tree that holds the winner of every match."""

    def __init__(self):
        self.leaves, self.heads, self.winner = 1, [None], [0, 0]

    def _play(self, node: int) -> None:
        a, b = self.winner[2 * node], self.winner[2 * node + 1]
        x, y = self.heads[a], self.heads[b]
        self.winner[node] = b if x is None or (y is not None and y < x) else a

    def put(self, run: int, head: tuple | None) -> None:
        """Give the run a new head (None: it has none) and play its matches again."""
        if run >= self.leaves:
            while run >= self.leaves:
                self.leaves *= 2
            self.heads += [None] * (self.leaves - len(self.heads))
            self.winner = [0] * self.leaves + list(range(self.leaves))
            for node in range(self.leaves - 1, 0, -1):
                self._play(node)
        self.heads[run] = head
        node = (self.leaves + run) // 2
        while node:
            self._play(node) if self.leaves > 1 else None
            node //= 2

    def best(self) -> tuple[int, tuple | None]:
        run = self.winner[1]
        return run, self.heads[run]


class Merge:
    """Merges runs given as blocks: (run, ascending keys), in the order of their first keys.

    A block is read when the merge reaches its first key, so of each run about one block is held.
    """

    def __init__(self, blocks: Iterator[tuple[int, list[tuple]]]):
        self.blocks, self.tree = blocks, Tournament()
        self.upcoming = next(blocks, None)
        self.places: dict[int, int] = {}
        self.held: list[Iterator[tuple]] = []

    def _admit(self) -> None:
        run, keys = self.upcoming
        self.upcoming = next(self.blocks, None)
        place = self.places.setdefault(run, len(self.held))
        if place == len(self.held):
            self.held.append(iter(()))
            self.tree.put(place, None)
        if self.tree.heads[place] is None:
            self.held[place] = iter(keys)
            self.tree.put(place, next(self.held[place]))
        else:  # the block before ends with this block's first key
            self.held[place] = itertools.chain(self.held[place], keys)

    def take(self, n: int) -> Iterator[tuple]:
        """The next n keys (all, if fewer)."""
        for _ in range(n):
            place, head = self.tree.best()
            while self.upcoming is not None and (head is None or self.upcoming[1][0] <= head):
                self._admit()
                place, head = self.tree.best()
            if head is None:
                return
            yield head
            self.tree.put(place, next(self.held[place], None))

    def rest(self) -> Iterator[tuple]:
        """What take has left, in no order."""
        for head, held in zip(self.tree.heads, self.held):
            if head is not None:
                yield head
                yield from held
        if self.upcoming is not None:
            yield from self.upcoming[1]
        for _, keys in self.blocks:
            yield from keys


def ranges(counts: list[tuple[int, int]], draw: int, rows: int = RANGE_ROWS) -> list[tuple[int, int]]:
    """(lowest score, eligible rows above) of consecutive ranges from the highest score down, until the draw is full.

    counts: the eligible rows of each score. A range closes with the first score that gives it ``rows`` rows.
    """
    out, above, held = [], 0, 0
    for score, n in sorted(counts, reverse=True):
        if above + held >= draw:
            break
        held += n
        if held >= rows or above + held >= draw:
            out.append((score, above))
            above, held = above + held, 0
    return out


KEYS = ["k0", "k1", "k2", "k3"]
RANKED = "doc_id long, n_features long, weight long, score long, rank long"


def draw(scored: DataFrame, percent: int = 25, block_rows: int = BLOCK_ROWS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """scored: a written table of doc_id, n_features, weight, score (long), eligible (boolean) -> RANKED, every row once.

    Of the N eligible rows, the floor(percent * N / 100) with the highest scores are drawn, ties to the smaller doc_id (then
    n_features), and get rank 1, 2, 3...; all others have a null rank. A null id, score or condition is not eligible.
    """
    can = F.coalesce(F.col("eligible") & F.col("doc_id").isNotNull() & F.col("score").isNotNull(), F.lit(False))
    scored = scored.select("doc_id", "n_features", "weight", "score", can.alias("eligible"))
    # scores are whole thousandths of a log ratio: some ten thousand values, however many rows there are
    counts = [(r["score"], r["n"]) for r in scored.where("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()]
    stop = percent * sum(n for _, n in counts) // 100
    found = ranges(counts, stop, max(range_rows, stop // MOST_RANGES))
    out = RANKED.replace(" long", "").split(", ")
    if not found:
        return scored.select(*out[:4], F.lit(None).cast("long").alias("rank"))
    lows, above = np.array([x[0] for x in found]), [x[1] for x in found]
    beyond = scored.where(~F.col("eligible") | (F.col("score") < int(lows[-1]))).select(*out[:4], F.lit(None).cast("long").alias("rank"))

    def block_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sorted rows, its run, in blocks that lie in one range."""
        seq = itertools.count()
        for batch in batches:
            keys = np.column_stack([batch[c].to_numpy() for c in KEYS])
            own = np.searchsorted(-lows, keys[:, 0])
            edges = np.unique(np.concatenate([[0, len(keys)], np.flatnonzero(np.diff(own)) + 1, np.arange(0, len(keys), block_rows)]))
            rows = [(int(own[a]), batch["run"][0].as_py(), next(seq), *keys[a].tolist(), keys[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
            if rows:
                yield pa.record_batch([pa.array(x) for x in zip(*rows)], names=["range", "run", "seq", *KEYS, "rows"])

    def merge_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks in the order of range and first key -> the range's rows with ranks up to the exact draw count."""
        blocks = ((r["range"], r["run"], r["rows"]) for batch in batches for r in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))))
        for k, own in itertools.groupby(blocks, key=lambda x: x[0]):
            merged = Merge((run, [tuple(x) for x in np.frombuffer(rows, dtype=np.int64).reshape(-1, 4).tolist()]) for _, run, rows in own)
            ranked = itertools.chain(zip(merged.take(stop - above[k]), itertools.count(above[k] + 1)), ((key, None) for key in merged.rest()))
            while some := list(itertools.islice(ranked, block_rows)):
                keys = np.array([key for key, _ in some], dtype=np.int64)
                columns = [pa.array(keys[:, 1]), pa.array(keys[:, 2]), pa.array(keys[:, 3]), pa.array(-keys[:, 0])]
                yield pa.record_batch([*columns, pa.array([rank for _, rank in some], pa.int64())], names=out)

    drawn = scored.where(F.col("eligible") & (F.col("score") >= int(lows[-1])))
    keyed = drawn.select((-F.col("score")).alias("k0"), F.col("doc_id").alias("k1"), F.col("n_features").alias("k2"), F.col("weight").alias("k3"), F.spark_partition_id().alias("run"))
    runs = keyed.sortWithinPartitions(*KEYS).mapInArrow(block_up, "range long, run long, seq long, k0 long, k1 long, k2 long, k3 long, rows binary")
    tasks = min(len(found), int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = runs.repartition(tasks, "range").sortWithinPartitions("range", *KEYS, "run", "seq")
    return dealt.select("range", "run", "rows").mapInArrow(merge_up, RANKED).unionByName(beyond)


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score, rank (long) of every row of docs (doc_id long, text), drawn towards target's texts.

    Rows of at least ``least_words`` words are eligible. A null or empty text has no words, weight 0, and is not eligible; a
    row without an id has no score and is not eligible. Rows that repeat are rows of their own. An empty target is the same
    as equal counts in all buckets; an empty docs gives no rows. Extra columns of either table are not read.
    """
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    weighed = weigh(docs.select("doc_id", "text"), gain)
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible"))
    return draw(cut(scored, "scored"), percent)
