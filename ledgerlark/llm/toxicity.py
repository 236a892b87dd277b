"""Toxicity by compression distance: zstandard dictionaries trained on toxic and on ordinary text, windows compressed by both.

Every word is written as three fixed-width codes (its first 4 bytes, its first 6 bytes, the whole word, lower-cased), so
that a window's length under a dictionary depends on which words the dictionary knows and not on the shape of the others.
Each dictionary is trained by zstandard on the labelled documents of its class, reduced to the codes that are markedly more
frequent in it: what both classes write would fill both dictionaries. Windows are 32 consecutive words of one document;
a document's features are what its windows save under the toxic dictionary against the ordinary one, and a logistic
curve fitted on the sample turns them into a probability (the calibrated threshold is 0.5).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .compression import calibrate, compressor, labelled_sample, probability, trained, window_lengths
from .text import Words, chunks, mix, word_hashes

WINDOW = 32
DICTIONARY_CODES, DICTIONARY_BYTES = 4096, 1 << 16
SAMPLE_EACH = 3000
#: A code must mark a class by this log-likelihood ratio and be so many times as frequent there.
SIGNIFICANT, TIMES = 14.0, 8.0
_BASES = (0x8CB92BA72F3D8DD7, 0xAAF96D4F7E24B1D3, 0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]


def _codes(words: Words) -> np.ndarray:
    """(number of words, 3) codes."""
    s, e = words.starts, words.ends
    return np.column_stack(
        [word_hashes(words.buf, s, np.minimum(s + k, e) if k else e, base) for k, base in zip((4, 6, 0), _BASES)]
    )


def _features(column: pa.ChunkedArray | pa.Array, toxic: bytes, ordinary: bytes) -> np.ndarray:
    """Per document: most bytes saved by a window, log of bytes saved by all, share of windows that save."""
    out = []
    by_toxic, by_ordinary = compressor(toxic, min_match=5), compressor(ordinary, min_match=5)
    for _, _, words in chunks(column, lower=True):
        codes = _codes(words)
        counts = np.diff(words.doc_words)
        windows = -(-counts // WINDOW)
        doc = np.repeat(np.arange(len(counts)), windows)
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        first = words.doc_words[:-1][doc] + rank * WINDOW
        size = np.minimum(WINDOW, words.doc_words[1:][doc] - first)
        width = codes.shape[1] * 8
        buf = codes.tobytes()
        saved = window_lengths(by_ordinary, buf, first * width, size * width) - window_lengths(by_toxic, buf, first * width, size * width)
        most, total, share = np.zeros(len(counts)), np.zeros(len(counts)), np.zeros(len(counts))
        np.maximum.at(most, doc, saved)
        np.add.at(total, doc, np.maximum(saved, 0))
        np.add.at(share, doc, saved > 2)
        out.append(np.column_stack([most, np.log1p(total), share / np.maximum(windows, 1)]))
    return np.concatenate(out) if out else np.zeros((0, 3))


def _count_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        y = batch["y"].to_numpy()
        for first, _, words in chunks(batch["text"], lower=True):
            codes = _codes(words)
            doc = np.repeat(np.arange(len(words.doc_words) - 1), np.diff(words.doc_words))
            doc, flat = np.repeat(doc, codes.shape[1]), codes.ravel()
            once = np.unique(flat + mix(doc.astype(np.uint64)), return_index=True)[1]  # each code of a document once
            code, inverse = np.unique(flat[once], return_inverse=True)
            toxic = np.bincount(inverse, weights=y[first + doc[once]], minlength=len(code)).astype(np.int64)
            every = np.bincount(inverse, minlength=len(code)).astype(np.int64)
            yield pa.record_batch([pa.array(code.view(np.int64)), pa.array(toxic), pa.array(every - toxic)], names=["code", "t", "o"])


def _marks(counted: DataFrame, mine: str, other: str, n_mine: int, n_other: int) -> np.ndarray:
    """The codes that mark one class, ascending as unsigned."""
    a, b = F.col(mine).cast("double"), F.col(other).cast("double")
    p, n = (a + b) / F.lit(float(n_mine + n_other)), float(n_mine + n_other)
    x_log = lambda k, total, q: F.when(k > 0, k * F.log(q)).otherwise(0.0) + F.when(total - k > 0, (total - k) * F.log(1 - q)).otherwise(0.0)
    m, o = F.lit(float(n_mine)), F.lit(float(n_other))
    ratio = 2 * (x_log(a, m, a / m) + x_log(b, o, b / o) - x_log(a, m, p) - x_log(b, o, p))
    found = (
        counted.where(a * o >= TIMES * b * m)
        .withColumn("llr", ratio)
        .where(F.col("llr") >= SIGNIFICANT)
        .orderBy(F.desc("llr"), "code")
        .limit(DICTIONARY_CODES)
        .select("code")
        .collect()
    )
    return np.sort(np.array([r["code"] for r in found], dtype=np.int64).view(np.uint64))


def _training_text(toxic: np.ndarray, ordinary: np.ndarray):
    """Each labelled document's text as the codes that mark its class, each once, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, out = batch["y"].to_numpy(), []
            for first, _, words in chunks(batch["text"], lower=True):
                codes = _codes(words)
                for d in range(len(words.doc_words) - 1):
                    own, marks = codes[words.doc_words[d] : words.doc_words[d + 1]].ravel(), toxic if y[first + d] else ordinary
                    own = own[np.isin(own, marks)]
                    out.append(own[np.sort(np.unique(own, return_index=True)[1])].tobytes())
            yield pa.record_batch([batch["y"], pa.array(out, pa.binary())], names=["y", "codes"])

    return run


def fit(docs: DataFrame, labels: DataFrame, held_out=None, each: int = SAMPLE_EACH) -> Model:
    """Fit on at most ``each`` labelled documents of either class (labels: doc_id, toxic 0/1; other values are ignored).

    held_out: a boolean Column over doc_id; rows where it is true are never learned from.
    Without labels of both classes the model is a constant near the only class (0.5 if there are none).
    """
    sample, counts = labelled_sample(docs, labels, "toxic", F.lit(False) if held_out is None else held_out, each)
    sizes = {int(r["y"]): int(r["count"]) for r in sample.groupBy("y").count().collect()}
    n_t, n_o = sizes.get(1, 0), sizes.get(0, 0)
    toxic = ordinary = b""
    if n_t and n_o:
        counted = (
            sample.mapInArrow(_count_codes, "code long, t long, o long").groupBy("code").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
        )
        run = _training_text(_marks(counted, "t", "o", n_t, n_o), _marks(counted, "o", "t", n_o, n_t))
        rows = sample.mapInArrow(run, "y int, codes binary").collect()  # 2 * each rows of DICTIONARY_CODES codes at most
        ordinary, toxic = (trained(sorted(bytes(r["codes"]) for r in rows if r["y"] == y), DICTIONARY_BYTES, k=16, d=8) for y in (0, 1))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _features(batch["text"], toxic, ordinary)
            yield pa.record_batch([batch["y"], *(pa.array(f[:, i]) for i in range(3))], names=["y", "a", "b", "c"])

    rows = sample.mapInArrow(measure, "y int, a double, b double, c double").collect()  # 2 * each small rows at most
    x = np.array([[r["a"], r["b"], r["c"]] for r in rows]).reshape(-1, 3)
    weights = calibrate(x, np.array([r["y"] for r in rows], dtype=int), counts)
    return Model(toxic, ordinary, tuple(float(v) for v in weights))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and toxicity (double, 0 to 1).

    A null or empty text has no windows and gets the score of a document that saves nothing.
    An existing column toxicity is replaced.
    """
    docs = docs.drop("toxicity")
    weights = np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probability(_features(batch["text"], model.toxic, model.ordinary), weights)
            yield pa.record_batch([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "toxicity"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("toxicity", DoubleType()))
