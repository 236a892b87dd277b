"""Compressed lengths of many windows under zstandard dictionaries, and the calibration of scores made from them."""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut

_compressors: dict[tuple[bytes, int, int], zstandard.ZstdCompressor] = {}


def trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """A zstandard dictionary of at most ``size`` bytes trained on the samples, with its entropy tables; empty without samples.

    zstandard refuses too few samples, so they count 4, 16 or 64 times, the least that it takes.
    """
    samples = [x for x in samples if len(x) >= 8]
    for times in (1, 4, 16, 64) if samples else ():
        some = samples * times
        try:
            return zstandard.train_dictionary(max(1024, min(size, sum(map(len, some)) // 2)), some, k=k, d=d, level=3).as_bytes()
        except zstandard.ZstdError:
            continue
    return b""


def compressor(dictionary: bytes, level: int = 3, min_match: int = 0) -> zstandard.ZstdCompressor:
    """A compressor primed with a trained dictionary (kept for the life of the worker); frames carry no header fields."""
    key = (dictionary, level, min_match)
    if key not in _compressors:
        own = {"min_match": min_match} if min_match else {}
        params = zstandard.ZstdCompressionParameters.from_level(
            level, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, **own
        )
        primed = {}
        if dictionary:
            primed["dict_data"] = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT)
            primed["dict_data"].precompute_compress(compression_params=params)
        _compressors[key] = zstandard.ZstdCompressor(compression_params=params, **primed)
    return _compressors[key]


def window_lengths(by: zstandard.ZstdCompressor, buf: bytes, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Compressed length of each window buf[offset:offset + size]; every size is positive."""
    if not len(offsets):
        return np.zeros(0, dtype=np.int64)
    segments = np.stack([offsets, sizes], axis=1).astype(np.uint64).tobytes()
    found = by.multi_compress_to_buffer(zstandard.BufferWithSegments(buf, segments), threads=1)
    return np.fromiter((len(x) for x in found), dtype=np.int64, count=len(offsets))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, held_out, each: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``each`` labelled documents of either class (text, y), and the number of labelled ids of each class.

    Only rows of which ``held_out`` (a Column over doc_id) is false are used, chosen by a hash of their id.
    The result is written to the shared storage.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out)
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    counts = {int(r["y"]): int(r["count"]) for r in known.groupBy("y").count().collect()}
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for y in (0, 1)]
    ids = F.broadcast(some[0].unionByName(some[1]))  # 2 * each small rows at most
    one = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # of a repeated id, the least text
    return cut(one.select("text", "y"), "labelled"), counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression on standardised columns, given back for plain columns."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    beta = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge * len(x) / 100)
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (weight * (y - p)) - penalty * beta
        bend = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    plain = beta[:-1] / sd
    return np.append(plain, beta[-1] - (plain * mean).sum())


def calibrate(x: np.ndarray, y: np.ndarray, counts: dict[int, int]) -> np.ndarray:
    """Logistic weights; classes weigh as often as they were labelled. With one class or none: a constant near it."""
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    width = x.shape[1] if x.ndim == 2 else 1
    if not n0 or not n1:
        return np.append(np.zeros(width), np.log((n1 + 0.5) / (n0 + 0.5)))
    weight = np.where(y == 1, counts.get(1, n1) / n1, counts.get(0, n0) / n0)
    return logistic(x, y.astype(float), weight / weight.mean())


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
