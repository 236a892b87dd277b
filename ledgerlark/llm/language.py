"""Language identification: scripts narrow the candidates, n-grams score each word, Viterbi labels spans of mixed text.

A model holds, for each language, the scripts of its letters and the log probabilities of hashed n-grams of its words (two to
four characters with the word's edges, and whole words), counted over all labelled rows. A word's candidates are the
languages that write its script. Viterbi then finds the labelling of a text's words with the greatest sum of word scores, less
a penalty for each change of language; runs of one label are spans, and the language with the most letters is the text's.

Most texts are of one language, and proving it is cheap: if no run of words gains more than the penalty by leaving the best
single language, no labelling beats that one. Only the others take the recurrence, all texts of a piece in step.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from .text import as_strings, mix

BUCKETS = 1 << 16
#: A run of letters without a break (some scripts write none) is taken in pieces of so many.
PIECE = 24
CHUNK_BYTES = 1 << 21
SWITCH_PENALTY = 12.0
#: A language writes a script that holds this share of its letters; other languages score this for a word of it.
SCRIPT_SHARE, FOREIGN = 0.01, -60.0
#: Log probabilities of one n-gram count for this much, since a word's n-grams overlap.
DAMPING = 0.5
UNKNOWN = "und"

# The first code points of ranges of scripts, by the Unicode blocks; what lies between is of script 0, "other".
SCRIPTS = ["other", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "devanagari", "bengali", "tamil", "thai", "georgian", "hangul", "kana", "han"]
RANGES = [
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0531, 0x058F, "armenian"), (0x0590, 0x05FF, "hebrew"),
    (0x0600, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0B80, 0x0BFF, "tamil"),
    (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"),
    (0x3040, 0x30FF, "kana"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7A3, "hangul"), (0xF900, 0xFAFF, "han"), (0x20000, 0x2FA1F, "han"),
]

_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 (no letter), 1 (a mark, part of a word) or 2 (a letter), and the number of the script."""
    if not _tables:
        kinds = np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x30000)], dtype=np.uint8)
        scripts = np.zeros(0x30000, dtype=np.uint8)
        for first, last, name in RANGES:
            scripts[first : last + 1] = SCRIPTS.index(name)
        _tables.update(kinds=np.append(kinds, [0]).astype(np.uint8), scripts=np.append(scripts, [0]).astype(np.uint8))
    return _tables["kinds"], _tables["scripts"]


class Words:
    """The words of some texts: runs of letters of one script (marks belong to the run before), lower-cased."""

    def __init__(self, texts: pa.Array):
        sizes = np.asarray(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        joined = "".join(pc.utf8_lower(texts).to_pylist())
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        kinds, scripts = _letters()
        at = np.minimum(points, 0x30000)
        kind, script = kinds[at], scripts[at]
        word = kind > 0
        # a mark has the script of what it follows
        owner = np.maximum.accumulate(np.where(kind != 1, np.arange(len(points)), 0)) if len(points) else np.zeros(0, dtype=np.int64)
        script = script[owner]
        begins = word.copy()
        begins[1:] &= ~word[:-1] | (script[1:] != script[:-1])
        inner = bounds[(bounds > 0) & (bounds < len(points))]
        begins[inner] = word[inner]
        starts = np.flatnonzero(begins)
        stops = ~word
        edge = np.zeros(len(points) + 1, dtype=bool)
        edge[:-1] = stops | begins
        edge[-1] = True
        edge[inner] = True
        edges = np.flatnonzero(edge)
        ends = edges[np.searchsorted(edges, starts, side="right")] if len(starts) else starts
        # long runs in pieces
        pieces = np.maximum(1, -(-(ends - starts) // PIECE))
        if len(starts) and pieces.max() > 1:
            of = np.repeat(np.arange(len(starts)), pieces)
            k = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            starts, ends = starts[of] + k * PIECE, np.minimum(starts[of] + (k + 1) * PIECE, ends[of])
        letters = np.concatenate([[0], np.cumsum(kind == 2)])
        some = letters[ends] > letters[starts]  # a run of marks alone is no word
        self.starts, self.ends = starts[some], ends[some]
        self.letters = (letters[self.ends] - letters[self.starts]).astype(np.int64)
        self.script = script[self.starts].astype(np.int64)
        self.points, self.bounds = points, bounds
        #: words[at[d]:at[d + 1]] belong to text d
        self.at = np.searchsorted(self.starts, bounds)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        size = self.ends - self.starts
        points = np.append(self.points, np.zeros(PIECE, dtype=np.uint32)).astype(np.uint64)
        out = mix(size.astype(np.uint64))
        for k in range(0, PIECE, 3):  # three characters at a time
            own = np.flatnonzero(size > k)
            if not len(own):
                break
            at, value = self.starts[own] + k, np.zeros(len(own), dtype=np.uint64)
            for j in range(3):
                value |= np.where(size[own] > k + j, points[at + j], 0).astype(np.uint64) << np.uint64(21 * j)
            out[own] = mix(out[own] ^ value)
        return out

    def features(self, some: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, place in some) of the n-grams of two to four characters, edges included, and of the whole word, of some words."""
        starts, size = self.starts[some], self.ends[some] - self.starts[some]
        padded = size + 2
        first = np.cumsum(padded) - padded
        word = np.repeat(np.arange(len(size)), padded)
        flat = np.zeros(int(padded.sum()), dtype=np.uint64)
        k = np.arange(len(flat)) - first[word] - 1
        inside = (k >= 0) & (k < size[word])
        flat[inside] = self.points[(starts[word] + k)[inside]]
        buckets, owners = [hashes[some] & np.uint64(BUCKETS - 1)], [np.arange(len(size))]
        run = flat
        for n in range(2, 5):
            run = mix(((run[:-1] << np.uint64(21)) | flat[n - 1 :]) ^ np.uint64(n << 42)) if len(run) else run
            same = word[: len(run)] == word[n - 1 :]
            buckets.append(run[same] & np.uint64(BUCKETS - 1))
            owners.append(word[: len(run)][same])
        return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first, end, words) for runs of texts of about CHUNK_BYTES; one long text may exceed it. A null text is empty."""
    texts = as_strings(column)
    texts = texts.fill_null("") if texts.null_count else texts
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, side="right")))
        yield first, end, Words(texts.slice(first, end - first))
        first = end


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scripts: np.ndarray  # (languages, scripts) boolean: who writes what
    logs: np.ndarray  # (BUCKETS, languages) float32: damped log probability of an n-gram


def fit(docs: DataFrame, held_out: Column | None = None) -> Model:
    """Counts over all rows of docs (text, lang) with a text and a lang that held_out (a boolean Column) doesn't set apart.

    Every task adds up its rows, so that a language of most rows is no burden. What comes back is a row for each language and
    non-empty bucket or script: its size depends on the number of languages alone. Without rows the model knows no language.
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.lit(True) if held_out is None else ~F.coalesce(held_out, F.lit(False)))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = batch["lang"].to_pylist()
            for first, end, words in _chunks(batch["text"]):
                names, of_doc = np.unique(np.array(langs[first:end], dtype=object), return_inverse=True)
                of_word, hashes = np.repeat(of_doc, np.diff(words.at)), words.hashes()
                for i, name in enumerate(names):
                    own = np.flatnonzero(of_word == i)
                    _, some, times = np.unique(hashes[own], return_index=True, return_counts=True)  # a word that repeats is taken apart once
                    bucket, word = words.features(own[some], hashes)
                    grams, scripts = totals.setdefault(name, (np.zeros(BUCKETS, dtype=np.int64), np.zeros(len(SCRIPTS), dtype=np.int64)))
                    grams += np.bincount(bucket, weights=times[word], minlength=BUCKETS).astype(np.int64)
                    scripts += np.bincount(words.script[own], weights=words.letters[own], minlength=len(SCRIPTS)).astype(np.int64)
        for name, own in totals.items():
            for kind, values in zip(("ngram", "script"), own):
                some = np.flatnonzero(values)
                yield pa.record_batch([pa.array([name] * len(some), pa.string()), pa.array([kind] * len(some), pa.string()), pa.array(some), pa.array(values[some])], names=["lang", "kind", "i", "n"])

    counted = known.mapInArrow(run, "lang string, kind string, i long, n long").groupBy("lang", "kind", "i").agg(F.sum("n").alias("n")).toArrow()
    lang, kind, at, n = (counted[c].to_numpy() for c in ("lang", "kind", "i", "n"))
    languages = sorted(set(lang.tolist()))
    grams, scripts = np.zeros((BUCKETS, len(languages))), np.zeros((len(languages), len(SCRIPTS)))
    for k, name in enumerate(languages):
        own = lang == name
        grams[at[own & (kind == "ngram")], k] = n[own & (kind == "ngram")]
        scripts[k, at[own & (kind == "script")]] = n[own & (kind == "script")]
    logs = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * BUCKETS)) * DAMPING
    return Model(tuple(languages), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1), logs.astype(np.float32))


def _scores(words: Words, model: Model) -> np.ndarray:
    """(words, languages): the sum of the n-grams' logs, less the best one; FOREIGN where the language doesn't write the word's script."""
    hashes = words.hashes()
    _, some, which = np.unique(hashes, return_index=True, return_inverse=True)  # a word that repeats is scored once
    bucket, word = words.features(some, hashes)
    out = np.empty((len(some), len(model.languages)))
    for k in range(len(model.languages)):
        out[:, k] = np.bincount(word, weights=model.logs[bucket, k], minlength=len(out))
    writes = model.scripts[:, words.script[some]].T
    nobody = ~writes.any(axis=1)
    best = np.where(writes, out, -np.inf).max(axis=1, initial=-np.inf)
    best[nobody] = 0
    out = np.where(writes, out - best[:, None], FOREIGN)
    out[nobody] = 0  # no language is known to write it: the words around decide
    return out[which]


def _viterbi(score: np.ndarray, at: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of each text's words. score: (words, languages); words[at[d]:at[d + 1]] are text d, none empty.

    A word whose best label leads by more than two changes cost has that label in every best labelling. Texts are cut before
    such words, and the parts, whose first labels and next labels are known, are labelled in step.
    """
    two = np.partition(score, -2, axis=1)[:, -2:]
    fixed = two[:, 1] - two[:, 0] > 2 * penalty
    top = score.argmax(axis=1)
    begins = fixed.copy()
    begins[at[:-1]] = True
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(score)))
    follows = np.append(starts[1:], len(score))  # the word after the part
    known = np.append(fixed, False)[follows] & ~np.isin(follows, at)
    score = np.where(fixed[:, None] & (np.arange(score.shape[1]) != top[:, None]), -np.inf, score)
    order = np.argsort(-sizes, kind="stable")
    first, sizes, follows, known = starts[order], sizes[order], follows[order], known[order]
    longest = int(sizes.max(initial=0))
    parts = np.searchsorted(-sizes, -np.arange(longest), side="left")  # how many parts have a word t
    back = np.zeros(score.shape, dtype=np.int32)  # from which label each label of a word came
    stays = np.arange(score.shape[1])[None, :]
    best = score[first].copy()
    for t in range(1, longest):
        n = parts[t]
        now = best[:n]
        lead = now.argmax(axis=1)
        change = now[np.arange(n), lead][:, None] - penalty
        moves = change > now
        back[first[:n] + t] = np.where(moves, lead[:, None], stays)
        best[:n] = np.where(moves, change, now) + score[first[:n] + t]
    # a change to the next part's first label costs as any other
    best -= penalty * (known[:, None] & (stays != top[np.minimum(follows, len(score) - 1)][:, None]))
    label, now = np.zeros(len(score), dtype=np.int64), best.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = parts[t]
        label[first[:n] + t] = now[:n]
        now[:n] = back[first[:n] + t, now[:n]]
    return label


def label_words(words: Words, model: Model, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The language number of every word, by the best labelling of each text."""
    score = _scores(words, model)
    label = np.zeros(len(score), dtype=np.int64)
    left = []
    for d in np.flatnonzero(np.diff(words.at)).tolist():
        a, b = words.at[d], words.at[d + 1]
        own = score[a:b]
        one = int(own.sum(axis=0).argmax())
        label[a:b] = one
        if len(model.languages) > 1:
            # what the best other language gains at each word; no run of words may gain more than one change costs
            gain = np.concatenate([[0.0], np.cumsum(np.delete(own, one, axis=1).max(axis=1) - own[:, one])])
            if (gain - np.minimum.accumulate(gain)).max() > penalty:
                left.append(d)
    if left:
        sizes = words.at[np.array(left) + 1] - words.at[left]
        at = np.concatenate([[0], np.cumsum(sizes)])
        own = np.repeat(words.at[left] - at[:-1], sizes) + np.arange(at[-1])
        label[own] = _viterbi(score[own], at, penalty)
    return label


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with lang_pred (string) and score (double): the language of most letters, and its share of them.

    Ties go to the language first in the alphabet. ``und`` and 0 for a text that is null or has no letter, or if the model
    knows no language. Columns of these names are replaced; other columns and repeated rows stay as they are.
    """
    docs = docs.drop("lang_pred", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        n = len(model.languages)
        for batch in batches:
            found, share = np.full(len(batch), n), np.zeros(len(batch))
            for first, end, words in _chunks(batch["text"]) if n else ():
                label = label_words(words, model)
                doc = np.repeat(np.arange(end - first), np.diff(words.at))
                letters = np.bincount(doc * n + label, weights=words.letters, minlength=(end - first) * n).reshape(-1, n)
                some = letters.sum(axis=1) > 0
                found[first:end] = np.where(some, letters.argmax(axis=1), n)
                share[first:end] = np.where(some, letters.max(axis=1) / np.maximum(letters.sum(axis=1), 1), 0.0)
            yield pa.record_batch([*batch.columns, pa.array(names[found], pa.string()), pa.array(share)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()))


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, span (int, from 0), lang, start, end (code points of the text), letters: the runs of words of one language.

    A span reaches from its first word's first letter to its last word's last one. Texts without letters have no span.
    """
    schema = StructType([docs.schema["doc_id"]]).add("span", IntegerType()).add("lang", StringType())
    for name in ("start", "end", "letters"):
        schema = schema.add(name, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, words in _chunks(batch["text"]) if model.languages else ():
                label = label_words(words, model)
                if not len(label):
                    continue
                doc = np.repeat(np.arange(end - first), np.diff(words.at))
                new = np.concatenate([[True], (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])])
                at = np.flatnonzero(new)
                last = np.append(at[1:], len(label)) - 1
                of, counts = doc[at], np.add.reduceat(words.letters, at)
                number = np.arange(len(at)) - np.searchsorted(of, of)
                yield pa.record_batch(
                    [
                        batch["doc_id"].take(pa.array(of + first)), pa.array(number.astype(np.int32)), pa.array([model.languages[k] for k in label[at]], pa.string()),
                        pa.array(words.starts[at] - words.bounds[of]), pa.array(words.ends[last] - words.bounds[of]), pa.array(counts),
                    ],
                    names=schema.names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)
