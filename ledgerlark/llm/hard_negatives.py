"""Hard negatives by blocked dense matrix products: each anchor's nearest rows of its label, then the rows of other labels just below them.

Anchors go to the tasks in blocks of bounded bytes; each task multiplies a block with its candidate rows, piece by piece, in
float64 (exact while no sum can reach 2^53; beyond that in Python's integers). The first pass keeps each anchor's best rows
of its own label. Such lists merge: the best of two parts are the best of the two lists. The second pass keeps, for each of
those positives, the best rows of other labels whose score lies in the window that the positive's score opens.

Both passes read the candidates once for each block of anchors, and a task returns a few rows for each anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, new_path

ANCHOR_BYTES = 32 << 20
#: Scores that a task holds at once.
SCORES = 1 << 20
EXACT = float(1 << 53)
FOUND = "anchor long, slot int, row long, vec_id long, score long"


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if dims else np.zeros((len(lists), 0), dtype=np.int64)


def _products(a: np.ndarray, b: np.ndarray, most_a: int) -> np.ndarray:
    """a @ b.T, exact: int64, or Python's integers where a sum could reach 2^53. most_a: the largest absolute value in a."""
    most = most_a * max(abs(int(b.max(initial=0))), abs(int(b.min(initial=0)))) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(object) @ b.astype(object).T if a.shape[1] else np.zeros((len(a), len(b)), dtype=np.int64)


class Best:
    """The k best (score descending, vec_id, row) of each of n lists; grows by pieces, and lists of several tasks merge alike."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.held = np.zeros((5, 0), dtype=object)
        #: the k-th score and id of each list, that a newcomer must beat; fewer than k: beaten by all
        self.kth = np.full(n, -(1 << 63), dtype=np.int64)
        self.kth_id = np.full(n, (1 << 63) - 1, dtype=np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.waiting = 0

    def open(self, score: np.ndarray, ids: np.ndarray, lists: slice) -> np.ndarray:
        kth, kth_id = self.kth[lists, None], self.kth_id[lists, None]
        return (score > kth) | ((score == kth) & (ids[None, :] <= kth_id))

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.parts.append((lists, score, ids, rows))
        self.waiting += len(lists)
        if self.waiting > max(4 * self.n * self.k, 1 << 16):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none, none
        lists, score, ids, rows = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((rows, ids, -score, lists))
        lists, score, ids, rows = lists[order], score[order], ids[order], rows[order]
        starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])) if len(lists) else np.zeros(0, dtype=np.int64)
        sizes = np.diff(np.append(starts, len(lists)))
        keep = np.arange(len(lists)) - np.repeat(starts, sizes) < self.k
        full = starts[sizes >= self.k] + self.k - 1
        self.kth[lists[full]], self.kth_id[lists[full]] = score[full], ids[full]
        self.parts = [(lists[keep], score[keep], ids[keep], rows[keep])]
        self.waiting = 0
        return self.parts[0]


@dataclass
class Block:
    """Some anchors of one number of dimensions, ascending by row."""

    row: np.ndarray
    label: np.ndarray
    v: np.ndarray
    lo: np.ndarray  # (anchors, slots): least and greatest score of each slot's window; lo > hi: no window
    hi: np.ndarray


def _pieces(batches: Iterator[pa.RecordBatch], blocks: dict[int, Block]):
    """(block, first anchor, anchors' end, ids, rows, same label, scores) for bounded pieces of candidates, ascending by id."""
    for batch in batches:
        all_dims = batch["dims"].to_numpy()
        for dims in sorted(set(all_dims.tolist()) & set(blocks)):
            block, own = blocks[dims], batch.filter(pa.array(all_dims == dims))
            ids = own["vec_id"].to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, rows, labels, v = ids[order], own["row"].to_numpy()[order], own["label"].to_numpy()[order], _matrix(own["v"], dims)[order]
            most = int(np.abs(block.v).max(initial=0))
            step = max(64, SCORES // max(1, len(block.row)))
            few = max(1, SCORES // step)
            for at in range(0, len(ids), step):
                to = slice(at, at + step)
                for first in range(0, len(block.row), few):
                    mine = slice(first, first + few)
                    yield block, mine, ids[to], rows[to], block.label[mine, None] == labels[None, to], _products(block.v[mine], v[to], most)


def _found(block: Block, best: Best, slots: int) -> pa.RecordBatch:
    lists, score, ids, rows = best.settle()
    columns = [pa.array(block.row[lists // slots]), pa.array((lists % slots).astype(np.int32)), pa.array(rows), pa.array(ids), pa.array(score.astype(np.int64))]
    return pa.record_batch(columns, names=[x.split()[0] for x in FOUND.split(", ")])


def _positives(blocks: dict[int, Block], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {dims: Best(len(b.row), k) for dims, b in blocks.items()}
        for block, mine, ids, rows, same, score in _pieces(batches, blocks):
            own = best[block.v.shape[1]]
            a, c = np.nonzero(same & own.open(score, ids, mine) & (block.row[mine, None] != rows[None, :]))
            own.add(a + mine.start, score[a, c], ids[c], rows[c])
        for dims, b in blocks.items():
            yield _found(b, best[dims], 1)

    return run


def _negatives(blocks: dict[int, Block], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = {dims: b.lo.shape[1] for dims, b in blocks.items()}
        best = {dims: Best(b.lo.size, k) for dims, b in blocks.items()}
        for block, mine, ids, rows, same, score in _pieces(batches, blocks):
            dims = block.v.shape[1]
            own, n = best[dims], slots[dims]
            other = ~same
            for s in range(n):
                lists = slice(mine.start * n + s, (mine.start + len(score)) * n, n)
                inside = other & (score <= block.hi[mine, s, None]) & (score >= block.lo[mine, s, None])
                a, c = np.nonzero(inside & own.open(score, ids, lists))
                own.add((a + mine.start) * n + s, score[a, c], ids[c], rows[c])
        for dims, b in blocks.items():
            yield _found(b, best[dims], slots[dims])

    return run


def _blocks(anchors: pa.Table, windows: dict[int, list[tuple[int, int, int]]] | None = None, slots: int = 1) -> dict[int, Block]:
    """The collected anchors of a block (row, label, dims, v) by dimensions. windows: (slot, lo, hi) of each anchor row."""
    anchors = anchors.combine_chunks().sort_by("row")
    out = {}
    for dims in sorted(set(anchors["dims"].to_pylist())):
        own = anchors.filter(pa.array(anchors["dims"].to_numpy() == dims)).combine_chunks()
        row = own["row"].to_numpy()
        lo, hi = np.ones((len(row), slots), dtype=np.int64), np.zeros((len(row), slots), dtype=np.int64)
        for i, r in enumerate(row.tolist()) if windows is not None else ():
            for slot, a, b in windows.get(r, ()):
                lo[i, slot], hi[i, slot] = a, b
        out[dims] = Block(row, own["label"].to_numpy(), _matrix(own["v"].combine_chunks(), dims), lo, hi)
    return out


def _merged(parts: DataFrame, k: int) -> DataFrame:
    """The k best of all tasks' lists, with their place (n, from 1)."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row")
    return parts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def mine(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score.

    vectors: vec_id (long), label (long), v (array<bigint>); anchors: a condition on vec_id and label that picks the rows
    that ask. A row's score is its integer inner product with the anchor; higher scores come first, ties by smaller vec_id.
    An anchor's positives are the first other rows of its label, its negatives for each positive the first rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score. Fewer rows give fewer results.

    Rows with a null id, label or vector, or with a null component, take no part. Rows that repeat an id are rows of their
    own, as are equal vectors. Only vectors of one number of dimensions are compared; an empty vector scores 0 with another.
    Scores must fit 64 bits. Extra columns are not read; no rows or no anchors give no rows.
    """
    spark = vectors.sparkSession
    known = vectors.where(F.expr("vec_id is not null and label is not null and v is not null and not exists(v, x -> x is null)"))
    # rows are numbered and written once: both passes must mean the same row by a number
    rows = known.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").cast("long").alias("label"), F.size("v").alias("dims"), "v", F.coalesce(anchors, F.lit(False)).alias("asks"))
    rows = cut(rows, "vectors")
    asked, candidates = rows.where("asks"), rows.select("row", "vec_id", "label", "dims", "v")
    size = asked.agg(F.coalesce(F.sum(8 * F.col("dims") + 32 * positives + 64), F.lit(0))).first()[0]
    if not size:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    n = -(-int(size) // ANCHOR_BYTES)
    in_block = lambda df, column, b: df.where(F.pmod(F.xxhash64(column), F.lit(n)) == b) if n > 1 else df
    near, far = new_path(spark, "positives"), new_path(spark, "negatives")
    for b in range(n):
        own = in_block(asked, "row", b).select("row", "label", "dims", "v").toArrow()  # about ANCHOR_BYTES
        if not len(own):
            continue
        sent = spark.sparkContext.broadcast(_blocks(own))
        part = candidates.mapInArrow(lambda batches, sent=sent: _positives(sent.value, positives)(batches), FOUND)
        _merged(part, positives).write.mode("append").parquet(near)
        sent.destroy()
        ours = in_block(spark.read.parquet(near), "anchor", b)
        windows: dict[int, list[tuple[int, int, int]]] = {}
        for r in ours.select("anchor", "n", "score").toArrow().to_pylist():  # at most ``positives`` small rows for each anchor of the block
            if r["score"] >= 0:  # a window below zero is empty
                windows.setdefault(r["anchor"], []).append((r["n"] - 1, -(-low * r["score"] // 100), high * r["score"] // 100))
        sent = spark.sparkContext.broadcast(_blocks(own, windows, positives))
        part = candidates.mapInArrow(lambda batches, sent=sent: _negatives(sent.value, negatives)(batches), FOUND)
        _merged(part, negatives).write.mode("append").parquet(far)
        sent.destroy()
    schema = FOUND + ", n int"
    positive = spark.read.schema(schema).parquet(near).select("anchor", (F.col("n") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    negative = spark.read.schema(schema).parquet(far).select("anchor", "slot", F.col("n").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return negative.join(positive, ["anchor", "slot"]).join(names, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
