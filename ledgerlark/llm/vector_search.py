"""Exact top-k inner products by a vector-approximation file.

The file holds the cells of every distinct vector (each component quantised to 256 intervals between the least and the
largest value of its dimension); exact vectors and the rows that hold them are kept apart. A search scans the cells only:
they bound every inner product from both sides. Vectors whose upper bound is below the k-th largest lower bound are out,
and the exact vectors of the others alone are read and multiplied.

Queries go to the tasks in blocks of bounded size against all cells. Equal vectors are one entry, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, look_up

CELLS = 256
QUERY_BYTES = 2 << 20
#: Bounds that a task holds at once.
BOUNDS = 1 << 21
KEY, ASKED = ["h", "g"], ["qh", "qg"]
FOUND = "qh long, qg long, h long, g long, middle double, slack double"


@dataclass(frozen=True)
class Index:
    rows: DataFrame  # row, vec_id, h, g: every row and the two hashes that name its vector
    exact: DataFrame  # h, g, dims, v, least: every distinct vector, and the smallest vec_id that has it
    cells: DataFrame  # h, g, dims, cells
    grid: dict[int, tuple[np.ndarray, np.ndarray]]  # by dims: least value and width of a cell, by dimension


def build(vectors: DataFrame) -> Index:
    """vectors: vec_id (long), v (array<bigint>); other columns are left out.

    Rows with a null id, or a null, empty or partly null vector take no part; repeated rows are rows of their own.
    """
    known = vectors.where("vec_id is not null and size(v) > 0 and not exists(v, x -> x is null)")
    plain = cut(
        known.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v", F.reverse("v")).alias("g")), "vectors"
    )
    distinct = plain.groupBy(*KEY).agg(F.first("v").alias("v"), F.min("vec_id").alias("least"))
    exact = cut(distinct.select(*KEY, F.size("v").alias("dims"), "v", "least"), "exact")
    spans = exact.select("dims", F.posexplode("v").alias("i", "x")).groupBy("dims", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # a row for each dimension
    grid = {}
    for dims in {r["dims"] for r in spans}:
        own = sorted((r["i"], r["lo"], r["hi"]) for r in spans if r["dims"] == dims)
        lo, hi = np.array([x[1] for x in own], dtype=float), np.array([x[2] for x in own], dtype=float)
        grid[dims] = (lo, np.maximum(np.ceil((hi - lo + 1) / CELLS), 1))

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for dims, v in zip(batch["dims"].to_pylist(), batch["v"].to_pylist()):
                lo, width = grid[dims]
                cells.append(np.clip((np.array(v, dtype=float) - lo) // width, 0, CELLS - 1).astype(np.uint8).tobytes())
            yield pa.record_batch([batch["h"], batch["g"], batch["dims"], pa.array(cells, pa.binary())], names=["h", "g", "dims", "cells"])

    cells = cut(exact.select(*KEY, "dims", "v").mapInArrow(quantise, "h long, g long, dims int, cells binary"), "approximations")
    return Index(plain.select("row", "vec_id", *KEY), exact, cells, grid)


class _Scan:
    """What some queries of one number of dimensions can still find."""

    def __init__(self, keys: np.ndarray, vectors: np.ndarray, lo: np.ndarray, width: np.ndarray, k: int):
        floats = vectors.astype(float)
        half = (width - 1) / 2
        self.keys, self.scaled, self.shift = keys, floats * width, floats @ (lo + half)
        largest = np.abs(lo) + CELLS * width
        # half a cell in every dimension, and more than what rounding can do
        self.slack = np.abs(floats) @ half + 1e-3 + 1e-13 * len(lo) * (np.abs(floats) @ largest)
        self.k, self.top = k, np.full((len(keys), k), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def least(self) -> np.ndarray:
        """The middle of its bounds below which a vector is out, by query."""
        return self.top[:, 0] - 2 * self.slack

    def scan(self, h: np.ndarray, g: np.ndarray, cells: np.ndarray) -> None:
        step = max(1, BOUNDS // len(self.keys))
        for at in range(0, len(h), step):
            middle = self.scaled @ cells[at : at + step].astype(float).T + self.shift[:, None]
            both = np.concatenate([self.top, middle], axis=1)
            self.top = np.sort(np.partition(both, -self.k, axis=1)[:, -self.k :], axis=1)
            q, i = np.nonzero(middle >= self.least()[:, None])
            self.found.append((q, h[at + i], g[at + i], middle[q, i]))
            self.held += len(q)
            if self.held > BOUNDS:
                self.prune()

    def prune(self) -> None:
        q, h, g, middle = (np.concatenate(x) for x in zip(*self.found))
        stays = middle >= self.least()[q]
        self.found = [(q[stays], h[stays], g[stays], middle[stays])]
        self.held = int(stays.sum())

    def rows(self) -> pa.RecordBatch:
        self.prune()
        q, h, g, middle = self.found[0]
        columns = [self.keys[q, 0], self.keys[q, 1], h, g, middle, self.slack[q]]
        return pa.record_batch([pa.array(c) for c in columns], names=[x.split()[0] for x in FOUND.split(", ")])


def _candidates(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """asked: h, g of distinct query vectors -> FOUND: what each task's cells leave open."""
    spark, grid = asked.sparkSession, index.grid
    n, dims_sum = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("dims"), F.lit(0))).first()
    blocks = max(1, -(-8 * int(dims_sum) // QUERY_BYTES))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod("h", F.lit(blocks)) == b).select(*KEY, "dims", "v").collect()  # about QUERY_BYTES
        of_dims: dict[int, list] = {}
        for r in rows:
            of_dims.setdefault(r["dims"], []).append(((r["h"], r["g"]), r["v"]))
        packed = {d: (np.array([x[0] for x in own], dtype=np.int64), np.array([x[1] for x in own], dtype=np.int64)) for d, own in of_dims.items()}
        sent = spark.sparkContext.broadcast(packed)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scans = {d: _Scan(keys, v, *grid[d], k) for d, (keys, v) in sent.value.items()}
            for batch in batches:
                all_dims = batch["dims"].to_numpy()
                for d in set(all_dims.tolist()) & set(scans):
                    own = batch.filter(pa.array(all_dims == d))
                    cells = np.frombuffer(b"".join(own["cells"].to_pylist()), dtype=np.uint8).reshape(-1, d)
                    scans[d].scan(own["h"].to_numpy(), own["g"].to_numpy(), cells)
            for x in scans.values():
                if x.found:
                    yield x.rows()

        part = index.cells.mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows for each query (queries: rows of index.rows).

    A row is no candidate of its own query; other rows of its id or vector are. Ties go to the smaller vec_id. Vectors of
    another number of dimensions are no candidates; fewer rows than k give fewer results. Scores must fit 64 bits.
    """
    queries = cut(queries.select("row", "vec_id", *KEY), "queries")
    asked = cut(queries.select(*KEY).distinct().join(index.exact, KEY), "asked")
    # one more than k, because a query's own vector may have no other row
    found = cut(_candidates(index, asked, k + 1), "candidates")
    by_middle = Window.partitionBy(*ASKED).orderBy(F.desc("middle"))
    kth = found.withColumn("n", F.row_number().over(by_middle)).where(F.col("n") <= k + 1).groupBy(*ASKED)
    least = kth.agg(F.when(F.count(F.lit(1)) == k + 1, F.min("middle")).otherwise(F.lit(float("-inf"))).alias("kth"))
    left = found.join(least, ASKED).where(F.col("middle") >= F.col("kth") - 2 * F.col("slack")).select(*ASKED, *KEY)
    product = F.expr("aggregate(zip_with(v, qv, (x, y) -> x * y), 0L, (s, x) -> s + x)")
    scored = (
        left.join(index.exact.select(*KEY, "v", "least"), KEY)
        .join(asked.select(F.col("h").alias("qh"), F.col("g").alias("qg"), F.col("v").alias("qv")), ASKED)
        .select(*ASKED, *KEY, "least", product.alias("score"))
    )
    best = Window.partitionBy(*ASKED).orderBy(F.desc("score"), "least")
    vectors = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select(*ASKED, *KEY, "score")
    # of one vector's rows, only the k + 1 smallest can be among the k best
    in_order = Window.partitionBy(*KEY).orderBy("vec_id", "row")
    few = index.rows.withColumn("n", F.row_number().over(in_order)).where(F.col("n") <= k + 1).select(*KEY, "vec_id", "row")
    lists = vectors.join(few, KEY).groupBy(*ASKED).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "row"))).alias("best"))  # (k + 1)**2 at most
    answered = look_up(queries, lists.select(F.col("qh").alias("h"), F.col("qg").alias("g"), "best"), KEY)
    own = F.slice(F.filter("best", lambda x: x["row"] != F.col("row")), 1, k)
    return answered.select(F.col("vec_id").alias("query_id"), F.posexplode(own).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score")
    )
