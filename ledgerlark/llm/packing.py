"""Best-fit-decreasing packing of documents into sequences of fixed capacity.

Only pieces' lengths matter to the packing, and there are at most ``capacity`` of them, so best-fit decreasing runs on
their counts: lengths from long to short, each placed in the tightest open bin that takes it, which a segment tree over
remaining capacities finds in logarithmic time. Equal steps are taken together (so many bins, so many pieces each), so
the plan has a bounded number of rows whatever the number of documents, and it is the plan that best-fit decreasing
makes of all pieces one by one. Each piece then looks up its place by its length and its rank among pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut
from .tokens import encoder

SLICE_DOCS = 256
PIECES = "part int, ordinal long, doc_id long, piece int, start long, length long, ids_crc32 long"


class Tree:
    """A segment tree over remaining capacities 0 .. n: how many open bins have each, and the least one that is large enough."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.some = [False] * (2 * self.size)

    def set(self, at: int, some: bool) -> None:
        at += self.size
        self.some[at] = some
        while at > 1:
            at >>= 1
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def tightest(self, least: int) -> int:
        """The smallest capacity of an open bin that is at least ``least``, or -1."""
        at = least + self.size
        if self.some[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for counts of lengths (1 .. capacity).

    Rows (length, rank from, rank to, pieces per bin, first bin, offset): pieces of that length with rank r in
    [from, to) go to bin first + (r - from) // per at offset + (r - from) % per * length.
    """
    tree, bins, rows, made = Tree(capacity), {}, [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                per = capacity // length
                runs, room = [(made, -(-left // per))], capacity
                made += runs[0][1]
            else:
                per, runs = room // length, bins.pop(room)
                tree.set(room, False)
            while runs:
                first, n = runs.pop()
                whole = min(n, left // per)
                for bin_, k, each in ((first, whole, per), (first + whole, int(whole < n and left > whole * per), left - whole * per)):
                    if k:
                        rows.append((length, rank, rank + k * each, each, bin_, capacity - room))
                        rank, left = rank + k * each, left - k * each
                        first, n = bin_ + k, n - k
                        rest = room - each * length
                        if rest:
                            bins.setdefault(rest, []).append((bin_, k))
                            tree.set(rest, True)
                if n:
                    runs.append((first, n))
                if not left:
                    break
            if runs:  # bins that were not needed stay as they were
                bins.setdefault(room, []).extend(runs)
                tree.set(room, True)
    return rows


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, special_as_text: bool = True) -> DataFrame:
    """The pieces of every document: its ids and end_id, cut from the end into pieces of ``capacity`` (the first may be shorter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, part, seen = encoder(tokenizer, special_as_text), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            for at in range(0, len(batch), SLICE_DOCS):
                some = batch.slice(at, SLICE_DOCS)
                rows = []
                for doc, code in zip(some["doc_id"].to_pylist(), by.encode(some["text"].to_pylist())):
                    code += end
                    n = len(code) // 4
                    low, high, k = 0, (n - 1) % capacity + 1, 0
                    while low < n:
                        rows.append((part, int(seen[high - low]), doc, k, low, high - low, zlib.crc32(code[4 * low : 4 * high])))
                        seen[high - low] += 1
                        low, high, k = high, high + capacity, k + 1
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, special_as_text: bool = True) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is end_id alone; repeated rows are documents of their own; a null doc_id stays null; an empty
    table gives no pieces.
    """
    spark = docs.sparkSession
    cutted = cut(pieces(docs, tokenizer, capacity, end_id, special_as_text), "pieces")  # ranks in a part stay as they were written
    by_part = cutted.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    base = by_part.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    counts = {int(r["length"]): int(r["n"]) for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    rows = plan(counts, capacity)
    where = spark.createDataFrame(rows, "length long, low long, high long, per long, bin long, at long") if rows else None
    if where is None:
        return cutted.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    steps = F.broadcast(where.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "per", "bin", "at"))).alias("steps")))  # a bounded plan
    placed = (
        cutted.join(base, ["length", "part"])
        .withColumn("rank", F.col("base") + F.col("ordinal"))
        .join(steps, "length")
        .withColumn("s", F.expr("filter(steps, x -> x.low <= rank and rank < x.high)[0]"))
    )
    q = F.col("rank") - F.col("s.low")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("s.bin") + F.floor(q / F.col("s.per"))).cast("long").alias("sequence_id"),
        (F.col("s.at") + q % F.col("s.per") * F.col("length")).cast("long").alias("offset"),
    )
