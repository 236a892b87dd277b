"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that agree on all bits of some table's mask meet in a bucket. In a task, the fingerprints of many buckets
are stored as bit planes (bit b of all of them, packed into 64-bit words). Every shift s compares each with the one s
places on: the planes' differences run through carry-save counters, 64 comparisons to a machine word, and a run of
planes is abandoned once all comparisons exceed the radius.

For a small radius the masks guarantee every link: of k blocks of bits, two fingerprints at distance r agree on k - r.
Buckets that grow too large are split again by the same rule on the bits that their mask left free, so no link is lost
and no bucket outgrows a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .components import components
from .store import cut, look_up
from .text import chunks

LARGE_BUCKET = 2048
LANES = 1 << 16
_ALL = (1 << 64) - 1


def majority(hashes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Per document a 64-bit word: the bits set in over half of its hashes (doc ascending); zero without hashes."""
    out = np.zeros(docs, dtype=np.uint64)
    if not len(hashes):
        return out
    at = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    n = np.diff(np.append(at, len(doc)))
    step = 1 << 16
    sums = np.zeros((len(at), 64), dtype=np.int64)
    for low in range(0, len(hashes), step):
        high = min(low + step, len(hashes))
        bits = np.unpackbits(hashes[low:high].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        a, b = np.searchsorted(at, low, side="right") - 1, np.searchsorted(at, high, side="left")
        sums[a:b] += np.add.reduceat(bits, np.maximum(at[a:b] - low, 0), axis=0, dtype=np.int64)
    out[doc[at]] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(column: pa.ChunkedArray | pa.Array, size: int = 3) -> np.ndarray:
    """64-bit SimHash of each text: XXH64 (seed 42) of the shingles of its words, A-Z lower-cased, joined by one space."""
    out, digest = [], xxhash.xxh64_intdigest
    for _, _, words in chunks(column, lower=True):
        n = words.ends - words.starts
        to = np.cumsum(n + 1) - (n + 1)  # place of each word once all are joined by one space
        joined = np.full(int((n + 1).sum()), 32, dtype=np.uint8)
        source = np.arange(len(joined)) - np.repeat(to - words.starts, n + 1)
        joined[:] = words.buf[np.minimum(source, len(words.buf) - 1)] if len(words.buf) else 32
        joined[to + n] = 32
        raw = joined.tobytes()
        first, end, doc = words.shingles(size)
        spans = zip(to[first].tolist(), (to[end - 1] + n[end - 1]).tolist())
        hashes = np.fromiter((digest(raw[a:b], 42) for a, b in spans), dtype=np.uint64, count=len(first))
        out.append(majority(hashes, doc, len(words.doc_words) - 1))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


# --- buckets ---------------------------------------------------------------------------------------------------------


def _shifted(plane: np.ndarray, s: int) -> np.ndarray:
    """Packed bits moved down by s places; bits beyond the end are zero."""
    whole, part = divmod(s, 64)
    out = np.zeros_like(plane)
    rest = plane[whole:]
    out[: len(rest)] = rest >> np.uint64(part)
    if part:
        out[: max(0, len(rest) - 1)] |= rest[1:] << np.uint64(64 - part)
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    raw = np.packbits(bits, bitorder="little")
    return np.pad(raw, (0, -len(raw) % 8)).view(np.uint64)


def close_pairs(fps: np.ndarray, bucket: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of one bucket whose fingerprints differ in at most ``radius`` bits, shift by shift.

    fps: (n, words) unsigned 64-bit; bucket: ascending numbers.
    """
    index, s = np.arange(len(fps)), 0
    width, n_counters = fps.shape[1] * 64, max(1, int(radius).bit_length())
    planes = size = None
    while True:
        s += 1
        last = np.searchsorted(bucket, bucket, side="right")
        if planes is None or s & (s - 1) == 0:  # drop buckets that all shifts have passed
            left = np.flatnonzero(last - np.searchsorted(bucket, bucket, side="left") > s)
            if not len(left):
                return
            fps, bucket, index = fps[left], bucket[left], index[left]
            last = np.searchsorted(bucket, bucket, side="right")
            bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
            planes = [_packed(bits[:, b]) for b in range(width)]
            size = len(fps)
        alive = _packed(np.arange(size) + s < last)
        counters = [np.zeros_like(alive) for _ in range(n_counters)]
        for b, plane in enumerate(planes):
            carry = plane ^ _shifted(plane, s)
            for k in range(n_counters):  # carry-save: add one bit to every counter
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            alive &= ~carry  # beyond what the counters hold
            if b % 8 == 7:
                alive &= ~_over(counters, radius)
                if not alive.any():
                    break
        else:
            i = np.flatnonzero(np.unpackbits(alive.view(np.uint8), bitorder="little")[:size])
            yield index[i], index[i + s]


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Which counters are larger than the radius."""
    more, equal = np.zeros_like(counters[0]), np.full_like(counters[0], _ALL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            more |= equal & counters[k]
            equal = equal & ~counters[k]
    return more


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Links that keep what the pairs connect: fewer than there are nodes."""
    parent = np.arange(n)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for left, right in pairs:
        new = parent[left] != parent[right]
        for a, b in zip(left[new].tolist(), right[new].tolist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                kept.append((a, b))
    return kept


def _children(free: tuple[int, ...], blocks: int, radius: int) -> list[tuple[int, tuple[int, ...]]]:
    """(mask, bits it leaves free) of the tables over the free bits: every choice of blocks - radius of the blocks."""
    parts = [free[len(free) * k // blocks : len(free) * (k + 1) // blocks] for k in range(blocks)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(1 << b for k in chosen for b in parts[k])
        out.append((mask, tuple(b for k in range(blocks) if k not in chosen for b in parts[k])))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def links(table: pa.Table) -> pa.RecordBatch:
            fps = table["fp"].to_numpy().view(np.uint64)
            path, bits = table["path"].to_numpy(), table["bits"].to_numpy()
            bucket = np.concatenate([[0], np.cumsum((path[1:] != path[:-1]) | (bits[1:] != bits[:-1]))])
            kept = np.array(_forest(len(fps), close_pairs(fps[:, None], bucket, radius)), dtype=np.int64).reshape(-1, 2)
            found = fps.view(np.int64)[kept]
            return pa.record_batch([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            held = table.combine_chunks()
            if len(held) >= LANES:  # the last bucket may go on in the next batch
                path, bits = held["path"].to_numpy(), held["bits"].to_numpy()
                same = (path == path[-1]) & (bits == bits[-1])
                cut_at = len(held) - int(same.sum())
                if cut_at:
                    yield links(held.slice(0, cut_at).combine_chunks())
                    held = held.slice(cut_at).combine_chunks()
        if held is not None and len(held):
            yield links(held)

    return run


def links_within(fps: DataFrame, radius: int = 2, blocks: int = 4) -> DataFrame:
    """fps: fp (long, distinct) -> links a, b that connect exactly what distances of at most ``radius`` connect."""
    paths: dict[tuple[int, ...], tuple[int, tuple[int, ...]]] = {(): (0, tuple(range(64)))}
    rows = fps.select("fp", F.lit(0).alias("path"))
    numbers, out = {(): 0}, None
    while True:
        # every path of this level to its children: (number, whole mask)
        level, offers = {}, {}
        for path, number in numbers.items():
            mask, left = paths[path]
            offers[number] = []
            for k, (more, rest) in enumerate(_children(left, blocks, radius)):
                child = (*path, k)
                paths[child], level[child] = (mask | more, rest), len(level) + 1
                offers[number].append((level[child], _signed(mask | more)))
        by = F.create_map(*[x for number, them in offers.items() for x in (F.lit(number), F.array(*[F.struct(F.lit(c).alias("path"), F.lit(m).alias("mask")) for c, m in them]))])
        keyed = rows.select("fp", F.explode(F.element_at(by, F.col("path"))).alias("t")).select(
            F.col("t.path").alias("path"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("bits"), "fp"
        )
        small_enough = max(len(paths[p][1]) for p in level) <= 11  # then no bucket can be larger than LARGE_BUCKET
        sizes = keyed.groupBy("path", "bits").count()
        busy = keyed.join(sizes.where("count > 1"), ["path", "bits"])
        found = (
            (busy if small_enough else busy.where(F.col("count") <= LARGE_BUCKET))
            .repartition("path", "bits")
            .sortWithinPartitions("path", "bits", "fp")
            .select("path", "bits", "fp")
            .mapInArrow(_compare(radius), "a long, b long")
        )
        out = found if out is None else out.unionByName(found)
        if small_enough:
            return out
        large = busy.where(F.col("count") > LARGE_BUCKET).select("fp", "path")
        if large.isEmpty():
            return out
        rows, numbers = cut(large, "buckets"), level


def group(docs: DataFrame, size: int = 3, radius: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (long) and component_id: the smallest doc_id reachable over fingerprints at most ``radius`` apart.

    A null or empty text has fingerprint zero and is linked like any other; repeated rows stay; a null doc_id gets the
    component of its fingerprint (null if only nulls are in it).
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch["doc_id"], pa.array(fingerprints(batch["text"], size).view(np.int64))], names=["doc_id", "fp"])

    schema = StructType([docs.schema["doc_id"]]).add("fp", LongType())
    made = cut(docs.mapInArrow(run, schema), "fingerprints")
    least = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links_within(least.select("fp"), radius))
    rooted = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = rooted.select("fp", "root").join(firsts, "root").select("fp", "component_id")
    return look_up(made, whole, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")
