"""Removal of passages that repeat, found by difference-cover anchors.

A window is ``length`` consecutive words of one document. Anchors (shorter windows) are hashed only at positions whose
remainder modulo a period lies in a difference cover: for any two windows that are equal, some anchor stands at the same
offset in both, because the cover has two members of every difference. So only windows around an anchor that repeats can
repeat, and only those are hashed and counted in a second round.

Both rounds work alike. Documents are dealt to small groups; each group sends the distinct hashes it holds, cut by value
into buckets; a bucket's task marks those that stand in two groups or twice in one, and answers every group with one bit
for each hash it sent. A passage that any number of documents share is so one row for each group and bucket at most.
Windows are compared by two independent 64-bit hashes: among 10**13 windows, two different ones agree on both with a
probability of about 10**-13.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .store import cut, text_bytes, unused
from .text import Words, as_strings, chunks, window_hashes

PERIOD, COVER = 21, (0, 1, 4, 14, 16)
GROUP_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_A, _B, _C = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3
SENT = "_bucket int, _g long, hashes binary, more binary, twice binary"
ANSWER = "_g long, _bucket int, bits binary"


def _docs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of the document of each word, and its end."""
    counts = np.diff(words.doc_words)
    return np.repeat(words.doc_words[:-1], counts), np.repeat(words.doc_words[1:], counts)


def _anchors(words: Words, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of documents that have a window, and their hashes."""
    size = length - PERIOD + 1
    first, end = _docs(words)
    at = np.arange(len(hashes))
    at = np.flatnonzero(_IN_COVER[(at - first) % PERIOD] & (at + size <= end) & (end - first >= length))
    return at, window_hashes(hashes, size, _A)[at]


def _windows(words: Words, hashes: np.ndarray, length: int, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that hold one of the given anchors, and both parts of their hashes."""
    first, end = _docs(words)
    step = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(step, np.maximum(first[anchors], anchors - PERIOD + 1), 1)
    np.add.at(step, anchors + 1, -1)
    at = np.flatnonzero((np.cumsum(step)[:-1] > 0) & (np.arange(len(hashes)) + length <= end))
    if not len(at):
        return at, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    return at, window_hashes(hashes, length, _B)[at], window_hashes(words.hashes(second=True), length, _C)[at]


def _distinct(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    found, counts = np.unique(every, return_counts=True)
    return found, counts > 1


def _places(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, by its high 32 bits: ascending with the hashes."""
    return ((sorted_hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _send(group: int, hashes: np.ndarray, twice: np.ndarray, more: np.ndarray | None, buckets: int) -> pa.Table:
    own, starts = np.unique(_places(hashes, buckets), return_index=True)  # only the buckets that these hashes fall into
    spans = list(zip(own.tolist(), starts.tolist(), [*starts[1:].tolist(), len(hashes)]))
    return pa.table(
        [
            pa.array([k for k, _, _ in spans], pa.int32()),
            pa.array([group] * len(spans), pa.int64()),
            pa.array([hashes[a:b].tobytes() for _, a, b in spans], pa.binary()),
            pa.array([b"" if more is None else more[a:b].tobytes() for _, a, b in spans], pa.binary()),
            pa.array([np.packbits(twice[a:b]).tobytes() for _, a, b in spans], pa.binary()),
        ],
        names=["_bucket", "_g", "hashes", "more", "twice"],
    )


def _mark(table: pa.Table) -> pa.Table:
    """One bucket: which of the hashes sent stand in two groups or twice in one."""
    sent = [np.frombuffer(x, dtype=np.uint64) for x in table["hashes"].to_pylist()]
    sizes = np.array([len(x) for x in sent])
    h = np.concatenate(sent)
    more = np.frombuffer(b"".join(table["more"].to_pylist()), dtype=np.uint64)
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n) for x, n in zip(table["twice"].to_pylist(), sizes)]) == 1
    order = np.lexsort((more, h)) if len(more) else np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if len(more):
        same &= more[order][1:] == more[order][:-1]
    run = np.concatenate([[0], np.cumsum(~same)]) if len(h) else np.zeros(0, dtype=np.int64)
    repeated = np.bincount(run) > 1
    repeated |= np.bincount(run, weights=twice[order]) > 0
    marked = np.zeros(len(h), dtype=bool)
    marked[order] = repeated[run]
    ends = np.cumsum(sizes)
    bits = [np.packbits(marked[e - n : e]).tobytes() for n, e in zip(sizes, ends)]
    return pa.table([table["_g"], table["_bucket"], pa.array(bits, pa.binary())], names=["_g", "_bucket", "bits"])


def _answered(hashes: np.ndarray, answer: pa.Table, buckets: int) -> np.ndarray:
    """The hashes (sorted, as they were sent) that were marked."""
    places, on = _places(hashes, buckets), np.zeros(len(hashes), dtype=bool)
    asked = np.array(answer["_bucket"].to_pylist(), dtype=np.uint64)
    for a, b, bits in zip(np.searchsorted(places, asked, "left"), np.searchsorted(places, asked, "right"), answer["bits"].to_pylist()):
        on[a:b] = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=b - a) == 1
    return hashes[on]


def _among(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array found."""
    if not len(found):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(found, values), len(found) - 1)
    return found[at] == values


def _joined(words: Words, keep: np.ndarray) -> list[bytes]:
    """Each document's kept words joined by one space."""
    s, n = words.starts[keep], (words.ends - words.starts)[keep]
    to = np.cumsum(n + 1) - (n + 1)
    out = np.empty(int((n + 1).sum()), dtype=np.uint8)
    at = np.arange(len(out)) + np.repeat(s - to, n + 1)
    out[:] = words.buf[np.minimum(at, len(words.buf) - 1)] if len(words.buf) else 32
    out[to + n] = 32
    kept = np.concatenate([[0], np.cumsum(keep)])[words.doc_words]
    ends = np.append(to, len(out))[kept]
    raw = out.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:])]


def remove_repeats(docs: DataFrame, length: int = 35, text: str = "text", rejoin: bool = True) -> DataFrame:
    """All columns of docs with the repeated words removed from text, and n_words, n_removed (long).

    A word goes if a window that covers it also starts anywhere else, in any document or the same one; windows are judged
    on the input. rejoin: the kept words of every document are joined by one space; else texts that lose nothing stay as
    they are. A null text has no words and stays null; repeated rows are documents of their own, so copies of at least
    ``length`` words lose all; shorter ones lose none; existing columns n_words and n_removed are replaced.
    ``length`` must be more than the period of the cover.
    """
    if length <= PERIOD:
        raise ValueError(f"length must be over {PERIOD}")
    docs = docs.drop("n_words", "n_removed")
    size = text_bytes(docs, text)[1]
    groups, buckets = max(1, -(-size // GROUP_BYTES)), max(1, -(-size // BUCKET_BYTES))
    # the id of a row in its file deals out rows evenly, whatever values repeat; it is written, so that all rounds see one deal
    names, g = docs.columns, unused("_g", docs)
    dealt = cut(docs.withColumn(g, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))), "dealt")
    schema = StructType([*docs.schema.fields]).add("n_words", LongType()).add("n_removed", LongType())

    def send_anchors(table: pa.Table) -> pa.Table:
        found = [_anchors(words, words.hashes(), length)[1] for _, _, words in chunks(table[text])]
        return _send(table[g][0].as_py(), *_distinct(found), None, buckets)

    def repeated_windows(table: pa.Table, anchors: pa.Table) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        each = [(words, h, *_anchors(words, h, length)) for words in (w for _, _, w in chunks(table[text])) for h in [words.hashes()]]
        some = _answered(_distinct([x[3] for x in each])[0], anchors, buckets)
        return [_windows(words, h, length, at[_among(a, some)]) for words, h, at, a in each]

    def send_windows(table: pa.Table, anchors: pa.Table) -> pa.Table:
        if not len(table) or not len(anchors):
            return _send(0, *_distinct([]), np.zeros(0, dtype=np.uint64), buckets)
        found = repeated_windows(table, anchors)
        h, more = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
        distinct, first, counts = np.unique(h, return_index=True, return_counts=True)
        return _send(table[g][0].as_py(), distinct, counts > 1, more[first], buckets)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows = answers.filter(pa.compute.equal(answers["_round"], 1)), answers.filter(pa.compute.equal(answers["_round"], 2))
        found = repeated_windows(table, rows[0])
        some = _answered(_distinct([x[1] for x in found])[0], rows[1], buckets)
        texts, n_words, n_removed = [], [], []
        for (_, _, words), (at, h, _) in zip(chunks(table[text]), found):
            step = np.zeros(len(words.starts) + 1, dtype=np.int64)
            at = at[_among(h, some)]
            step[at] += 1
            np.add.at(step, at + length, -1)
            gone = np.cumsum(step)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            n_words.append(np.diff(words.doc_words))
            n_removed.append(np.diff(total[words.doc_words]))
            texts += _joined(words, ~gone)
        counts, removed = np.concatenate(n_words), np.concatenate(n_removed)
        old = as_strings(table[text])
        new = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        unchanged = old.is_null() if rejoin else pa.compute.or_(old.is_null(), pa.array(removed == 0))
        new = pa.compute.if_else(unchanged, old, new).cast(pa.string())
        columns = [new if name == text else table[name] for name in names]
        return pa.table([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*names, "n_words", "n_removed"])

    anchors = dealt.groupBy(g).applyInArrow(send_anchors, SENT).groupBy("_bucket").applyInArrow(_mark, ANSWER)
    windows = (
        dealt.groupBy(g).cogroup(anchors.groupBy("_g")).applyInArrow(send_windows, SENT).groupBy("_bucket").applyInArrow(_mark, ANSWER)
    )
    answers = anchors.withColumn("_round", F.lit(1)).unionByName(windows.withColumn("_round", F.lit(2)))
    return dealt.groupBy(g).cogroup(answers.groupBy("_g")).applyInArrow(remove, schema)
