"""Token ids as directly addressable codes: chunk levels, continuation bitmaps and rank directories.

Layout of one block of n ids (all arrays little-endian):
level 0 holds the low byte of every id; its bitmap has a 1 for each id that continues; level k + 1 holds the next byte of
those ids, in order, and so on until no id continues. Beside each bitmap stands a rank directory: the number of ones
before every 512th bit. Id i is read by one byte and one bit of each level, its place in the next level being the rank of
its bit, so any id is reached without decoding a block.

A file set is a Parquet dataset whose rows are blocks of whole documents (part, block, doc ids, local starts, levels,
bitmaps, directories), written in ascending doc_id order: part after part, block after block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import text_bytes
from .tokens import encoder

RANK_BITS = 512
BLOCK_IDS = 1 << 20
PART_BYTES = 16 << 20
SLICE_DOCS = 256
SCHEMA = "part int, block int, start long, n_ids long, doc_ids binary, doc_nulls binary, doc_starts binary, levels array<binary>, bitmaps array<binary>, ranks array<binary>"


def encode(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """(levels, bitmaps, rank directories) of unsigned 32-bit ids."""
    levels, bitmaps, ranks = [], [], []
    rest = np.asarray(ids, dtype=np.uint32)
    while len(rest):
        levels.append(rest.astype(np.uint8).tobytes())
        rest = rest >> np.uint32(8)
        on = rest > 0
        bits = np.packbits(on, bitorder="little")
        bitmaps.append(bits.tobytes())
        ones = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), RANK_BITS // 8), dtype=np.uint32)
        ranks.append((np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes())
        rest = rest[on]
    return levels, bitmaps, ranks


class Block:
    """Random access to the ids of one block."""

    def __init__(self, levels: list[bytes], bitmaps: list[bytes], ranks: list[bytes]):
        self.levels = [np.frombuffer(x, dtype=np.uint8) for x in levels]
        self.bitmaps = [np.frombuffer(x, dtype=np.uint8) for x in bitmaps]
        self.ranks = [np.frombuffer(x, dtype="<u4") for x in ranks]

    def _rank(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of bitmap k before each bit position."""
        bits, byte = self.bitmaps[k], at >> 3
        first = at // RANK_BITS
        before = self.ranks[k][first].astype(np.int64)
        # at most 63 whole bytes lie between the directory's entry and the bit
        for i in range(RANK_BITS // 8 - 1):
            here = first * (RANK_BITS // 8) + i
            on = here < byte
            if not on.any():
                break
            before[on] += np.bitwise_count(bits[here[on]])
        return before + np.bitwise_count(bits[byte] & ((1 << (at & 7)) - 1).astype(np.uint8))

    def get(self, at) -> np.ndarray:
        """The ids at the given places (any order, repeats allowed)."""
        at = np.atleast_1d(np.asarray(at, dtype=np.int64))
        out, who = np.zeros(len(at), dtype=np.uint32), np.arange(len(at))
        for k, level in enumerate(self.levels):
            out[who] |= level[at].astype(np.uint32) << np.uint32(8 * k)
            on = (self.bitmaps[k][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            who, at = who[on], at[on]
            if not len(at):
                break
            at = self._rank(k, at)
        return out

    def range(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end - 1: one rank at the start of each level, then runs."""
        out, who = np.zeros(end - start, dtype=np.uint32), np.arange(end - start)
        for k, level in enumerate(self.levels):
            if start >= end:
                break
            out[who] |= level[start:end].astype(np.uint32) << np.uint32(8 * k)
            low = start & ~7
            on = np.unpackbits(self.bitmaps[k][low >> 3 : (end + 7) >> 3], bitorder="little")[start - low : end - low] == 1
            who = who[on]
            start = int(self._rank(k, np.array([start]))[0]) if len(who) else 0
            end = start + len(who)
        return out


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", special_as_text: bool = True) -> None:
    """Encode every whole text, append end_id, and write the ids in ascending order of id_column (nulls first; ties by text).

    Repeated rows stay repeated documents, an empty or null text is end_id alone, an empty table is a dataset of no rows.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    parts = max(1, -(-text_bytes(docs)[1] // PART_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        ids, found, held = [], [], 0
        by = encoder(tokenizer, special_as_text)
        end = int(end_id).to_bytes(4, "little")

        def full() -> pa.RecordBatch:
            sizes = np.array([len(x) // 4 for x in found], dtype="<i8")
            numbers = np.frombuffer(b"".join(found), dtype="<u4")
            levels, bitmaps, ranks = encode(numbers)
            row = [
                part, block, start, len(numbers),
                np.array([x or 0 for x in ids], dtype="<i8").tobytes(), np.array([x is None for x in ids], dtype=np.uint8).tobytes(),
                (np.cumsum(sizes) - sizes).astype("<i8").tobytes(), levels, bitmaps, ranks,
            ]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.binary())] * 3]
            return pa.record_batch([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            for at in range(0, len(batch), SLICE_DOCS):
                some = batch.slice(at, SLICE_DOCS)
                for doc, code in zip(some["doc_id"].to_pylist(), by.encode(some["text"].to_pylist())):
                    ids.append(doc)
                    found.append(code + end)
                    held += len(code) // 4 + 1
                    if held >= BLOCK_IDS:
                        yield full()
                        start, block = start + held, block + 1
                        ids, found, held = [], [], 0
        if ids:
            yield full()

    ordered = docs.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text").mapInArrow(run, SCHEMA).write.option(
        "compression", "uncompressed"
    ).parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 over its ids."""
    blocks = spark.read.schema(SCHEMA).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each part

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row["levels"], row["bitmaps"], row["ranks"])
                starts = np.append(np.frombuffer(row["doc_starts"], dtype="<i8"), row["n_ids"])
                docs, nulls = np.frombuffer(row["doc_ids"], dtype="<i8"), np.frombuffer(row["doc_nulls"], dtype=np.uint8) == 1
                crc, low = [], 0
                while low < len(docs):  # documents of about 64k ids at a time
                    high = max(low + 1, int(np.searchsorted(starts, starts[low] + 65536, side="right")) - 1)
                    ids = block.range(int(starts[low]), int(starts[high])).astype("<u4").tobytes()
                    at = (starts[low : high + 1] - starts[low]) * 4
                    crc += [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
                    low = high
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(docs), row["part"], dtype=np.int32)), pa.array(docs, mask=nulls), pa.array(starts[:-1] + row["start"]),
                        pa.array(np.diff(starts)), pa.array(crc, pa.int64()),
                    ],
                    names=["part", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    docs = blocks.mapInArrow(run, "part int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(before, "part").select("doc_id", (F.col("local") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")

