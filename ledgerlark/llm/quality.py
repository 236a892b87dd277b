"""Quality by compression: a document's size under a zstandard dictionary of bad text against that of good text.

Both dictionaries are trained by zstandard, entropy tables included, on windows of the labelled sample's whole texts. A text is cut into windows of 2048 bytes,
each window is compressed under both dictionaries, and the document's features are the size difference as a share of its
bytes (over all of it, and of its best and worst window) and its share of bytes left under the good dictionary (copies
inside a text shrink it). A logistic curve fitted on the sample makes them a probability of label 1.
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
from .text import as_strings

WINDOW_BYTES = 2048
DICTIONARY_BYTES = 1 << 15
SAMPLE_EACH = 3000
#: Windows of either class that dictionaries are trained on, at most, chosen by a hash of their bytes among all windows of the sample.
TRAIN_WINDOWS = 8192
RUN_BYTES = 1 << 22
N_FEATURES = 5


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]


def _runs(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    """(offsets of documents, their bytes) for runs of documents of about RUN_BYTES."""
    texts = as_strings(column).fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = memoryview(texts.buffers()[2]) if texts.buffers()[2] is not None else memoryview(b"")
    first = 0
    while first < n:
        end = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, side="right")) - 1))
        yield offsets[first : end + 1] - offsets[first], bytes(data[offsets[first] : offsets[end]])
        first = end


def _features(column: pa.ChunkedArray | pa.Array, good: bytes, bad: bytes) -> np.ndarray:
    by_good, by_bad = compressor(good), compressor(bad)
    out = []
    for bounds, buf in _runs(column):
        size = np.diff(bounds)
        windows = -(-size // WINDOW_BYTES)
        doc = np.repeat(np.arange(len(size)), windows)
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        first = bounds[:-1][doc] + rank * WINDOW_BYTES
        length = np.minimum(WINDOW_BYTES, bounds[1:][doc] - first)
        g, b = window_lengths(by_good, buf, first, length), window_lengths(by_bad, buf, first, length)
        each = (b - g) / (length + 16)
        sums = lambda x: np.bincount(doc, weights=x, minlength=len(size))
        total = sums(length)
        most, least = np.full(len(size), -1.0), np.full(len(size), 1.0)
        np.maximum.at(most, doc, each)
        np.minimum.at(least, doc, each)
        empty = windows == 0
        most[empty] = least[empty] = 0
        out.append(np.column_stack([(sums(b) - sums(g)) / (total + 16), most, least, sums(g) / (total + 16), np.log1p(total)]))
    return np.concatenate(out) if out else np.zeros((0, N_FEATURES))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of whole texts."""
    for batch in batches:
        ys, found = [], []
        for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist()):
            raw = (text or "").encode()
            found += [raw[at : at + WINDOW_BYTES] for at in range(0, len(raw), WINDOW_BYTES)]
            ys += [y] * (len(found) - len(ys))
        yield pa.record_batch([pa.array(ys, pa.int32()), pa.array(found, pa.binary())], names=["y", "w"])


def fit(docs: DataFrame, labels: DataFrame, held_out=None, each: int = SAMPLE_EACH) -> Model:
    """Fit on at most ``each`` labelled documents of either class (labels: doc_id, quality 0/1; other values are ignored).

    held_out: a boolean Column over doc_id; rows where it is true are never learned from.
    Without labels of both classes the model is a constant near the only class (0.5 if there are none).
    """
    sample, counts = labelled_sample(docs, labels, "quality", F.lit(False) if held_out is None else held_out, each)
    windows = sample.mapInArrow(_windows, "y int, w binary").withColumn("h", F.xxhash64("w"))
    some = [windows.where(F.col("y") == y).orderBy("h", "w").limit(TRAIN_WINDOWS).select("w").collect() for y in (0, 1)]
    bad, good = (trained([bytes(r["w"]) for r in rows], DICTIONARY_BYTES, k=64, d=8) for rows in some)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = _features(batch["text"], good, bad)
            yield pa.record_batch([batch["y"], pa.array(list(f), pa.list_(pa.float64()))], names=["y", "f"])

    measured = sample.mapInArrow(measure, "y int, f array<double>").collect()
    x = np.array([r["f"] for r in measured]).reshape(-1, N_FEATURES)
    weights = calibrate(x, np.array([r["y"] for r in measured], dtype=int), counts)
    return Model(good, bad, tuple(float(v) for v in weights))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and quality (double, 0 to 1: the probability of label 1).

    A null or empty text has no windows and gets the score of zero features. An existing column quality is replaced.
    """
    docs = docs.drop("quality")
    weights = np.array(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = probability(_features(batch["text"], model.good, model.bad), weights)
            yield pa.record_batch([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "quality"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("quality", DoubleType()))
