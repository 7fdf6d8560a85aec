"""Bradley-Terry quality ranking: scores from preference pairs, thresholded at a quantile.

Every labelled text of the better class is preferred to texts of the worse class. With features x, the
chance that a beats b is the logistic function of w . (x_a - x_b): the weights minimise the logistic loss
on feature differences, with a small ridge. A document's strength is w . x; the cut is the strength's
quantile at the share of the worse class among training texts, and a monotone map puts it at `CUT`.

Features are shares and counts of the whole text (letters, capitals, symbols, repeated words, word pairs
and lines, line lengths and the like), computed with numpy on the bytes, so a document never leaves its
partition. Training is fitted on a sample of labelled rows bounded by `TRAIN_ROWS` (those of smallest id
hash); its features, one short vector a row, are all that reaches the driver.

Defined results: a null or empty text, or one without words, scores 0; ties
have equal scores; without labelled rows of both classes every score is `CUT`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.words import Texts, Words, gram_hashes, lowered, slices, texts_of, tidied, word_hashes, words_of

#: Labelled rows that may be used for training.
TRAIN_ROWS = 20_000
#: Preference pairs drawn for every text of the worse class.
PAIRS = 24
#: Score at which a document passes.
CUT = 0.3

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x41:0x5B] = 2
_KIND[0x30:0x3A] = 3
_KIND[[ord(c) for c in "#*$%&<>@^~=+_\\/{}[]"]] = 4
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 5
_KIND[[ord(c) for c in "!?"]] = 6
_KIND[ord("|")] = 7
_KIND[0x0A] = 8

FEATURES = (
    "capitals", "digits", "symbols", "points", "shouts", "bars", "longest_symbol_run", "word_length", "word_spread",
    "short_words", "distinct", "repeat_next", "repeat_pairs", "repeat_triples", "top_word", "repeat_lines", "line_words",
    "shout_words", "symbol_words", "bar_words", "log_words", "few_words", "plain_ends",
)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


def _repeats(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For every text: items that occurred earlier in it, and the count of its commonest item."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    again = np.bincount(o[~fresh], minlength=n).astype(float)
    top = np.zeros(n)
    begin = np.flatnonzero(fresh)
    np.maximum.at(top, o[begin], np.diff(np.append(begin, len(h))))
    return again, top


def features(texts: Texts) -> np.ndarray:
    """One row of `FEATURES` a text."""
    n, data, at = len(texts), texts.data, texts.offsets
    kind = _KIND[data]
    size = np.maximum(np.diff(at), 1)
    share = [_sums(kind == k, at) for k in range(9)]
    letters = np.maximum(share[1] + share[2], 1)
    words = words_of(texts)
    owner, counts = words.owner, np.maximum(words.counts, 1)
    hashes = word_hashes(lowered(texts), words)
    length = (words.end - words.start).astype(float)
    mean = _sums(length, words.first) / counts
    again, top = _repeats(hashes, owner, n)
    inner = [owner[k:] == owner[: len(owner) - k] for k in (1, 2)]
    pairs, _ = _repeats(gram_hashes(hashes, 2)[inner[0]], owner[:-1][inner[0]], n)
    triples, _ = _repeats(gram_hashes(hashes, 3)[inner[1]], owner[:-2][inner[1]], n)
    next_same = np.bincount(owner[1:][inner[0] & (hashes[1:] == hashes[:-1])], minlength=n) if len(owner) else np.zeros(n)
    has = [np.concatenate(([0], np.cumsum(kind == k))) for k in (2, 1, 4, 6, 7, 5)]
    within = [c[words.end] - c[words.start] for c in has]
    shout_words = (within[0] > 1) & (within[1] == 0)
    lines = words_of(texts, np.arange(256) == 0x0A)
    line_hash = word_hashes(texts, lines)
    line_again, _ = _repeats(line_hash, lines.owner, n)
    line_count = np.maximum(lines.counts, 1)
    last = data[np.maximum(lines.end - 1, 0)] if len(lines.end) else np.zeros(0, np.uint8)
    plain = np.isin(last, np.frombuffer(b".!?:", np.uint8))
    run = (kind == 4) | (kind == 6)
    double = np.zeros(len(data), dtype=bool)
    double[1:] = run[1:] & run[:-1]
    return np.column_stack([
        share[2] / letters, share[3] / size, share[4] / size, share[5] / size, share[6] / size, share[7] / size,
        _sums(double, at) / size, mean / 10, np.sqrt(np.maximum(_sums(length**2, words.first) / counts - mean**2, 0)) / 10,
        _sums(length <= 2, words.first) / counts, 1 - again / counts, next_same / counts, pairs / counts, triples / counts,
        top / counts, line_again / line_count, np.log1p(counts / line_count) / 5,
        _sums(shout_words, words.first) / counts, _sums(within[2] > 1, words.first) / counts,
        _sums(within[4] > 0, words.first) / counts, np.log1p(words.counts) / 10, words.counts < 20,
        _sums(plain, lines.first) / line_count,
    ])


class Ranking:
    """Weights of the features, and the strength at which a text passes."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, spread: np.ndarray, cut: float, slope: float):
        self.weights, self.mean, self.spread, self.cut, self.slope = weights, mean, spread, cut, slope

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Scores of feature rows; a text without words has nothing to keep and scores 0."""
        strength = ((rows - self.mean) / self.spread) @ self.weights
        at = self.slope * (strength - self.cut) + np.log(CUT / (1 - CUT))
        return np.where(rows[:, FEATURES.index("log_words")] > 0, 1 / (1 + np.exp(-np.clip(at, -40, 40))), 0.0)


def fit(rows: np.ndarray, better: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> Ranking:
    """Logistic loss on feature differences of (better, worse) pairs, by Newton's method."""
    mean = rows.mean(axis=0) if len(rows) else np.zeros(len(FEATURES))
    spread = rows.std(axis=0) + 1e-6 if len(rows) else np.ones(len(FEATURES))
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    weights = np.zeros(rows.shape[1] if rows.ndim == 2 else len(FEATURES))
    if not len(good) or not len(bad):
        return Ranking(weights, mean, spread, 0.0, 1.0)
    scaled = (rows - mean) / spread
    rng = np.random.default_rng(7)
    lost = np.repeat(bad, PAIRS)
    apart = scaled[rng.choice(good, len(lost))] - scaled[lost]
    for _ in range(steps):
        won = 1 / (1 + np.exp(-np.clip(apart @ weights, -30, 30)))
        slope = apart.T @ (1 - won) - ridge * len(apart) * weights
        bend = (apart * (won * (1 - won))[:, None]).T @ apart + ridge * len(apart) * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    strength = scaled @ weights
    cut = float(np.quantile(strength, len(bad) / len(rows), method="midpoint"))
    # midway in the gap around the quantile
    below, above = strength[strength < cut], strength[strength >= cut]
    if len(below) and len(above):
        cut = float(below.max() + above.min()) / 2
    gap = abs(float(np.median(strength[good]) - np.median(strength[bad])))
    return Ranking(weights, mean, spread, cut, 6 / gap if gap > 0 else 1.0)


def _identity(column: str):
    """The documents' `remainder`: crc32 of the id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def feature_rows(docs: DataFrame) -> DataFrame:
    """`doc_id, features` (array of double) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = list(features(texts_of(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "features"])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(tidied(run), "doc_id long, features array<double>")


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = TRAIN_ROWS) -> Ranking:
    """Fit on at most `rows` labelled documents outside the held-out fold, those of smallest id hash."""
    marked = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (_identity("doc_id") % folds != held))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    known = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(marked.select("doc_id")), "doc_id", "left_semi")
    found = feature_rows(known).join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.first("features"), F.first("quality")).collect()
    found.sort(key=lambda r: r[0])
    matrix = np.array([r[1] for r in found], dtype=float).reshape(len(found), len(FEATURES))
    return fit(matrix, np.array([r[2] for r in found], dtype=float) >= 1)


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """`doc_id, score` (0 to 1) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = model.scores(features(texts_of(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, score double")


def accepted(docs: DataFrame, model: Ranking) -> DataFrame:
    """The rows of `docs` that pass, with all their columns; every row is judged where it lies."""
    schema = docs.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                passes = model.scores(features(texts_of(part.column("text")))) >= CUT
                yield part.filter(pa.array(passes))

    return docs.mapInArrow(tidied(run), schema)
