"""Ordinal quality classifier: cumulative-link regression on hashed text features.

Graded ratings 0 < 1 < ... < K share one weight vector over hashed features of the
text; K ordered thresholds cut the score into grades, P(grade <= k) = sigmoid(t_k - s).
That gives an expected grade and the tail probability that selection uses.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaint.llm.batches import hold, keep_texts, least_rows
from quantaint.llm.shingles import words

FEATURES = 1 << 18
# Labelled rows that the classifier is fitted on: those of least hash.
SAMPLE = 12_000
# A document is kept if the best grade is at least this likely.
LEAST_TAIL = 0.5
_ENDS = b".,;:!?\"'()[]{}*#$%&|<>-_"
_SHAPES = (b"!!", b"***", b"###", b"$$$", b"%%%", b"&&&", b"|", b"<", b"@", b"http")
_STEPS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
_REMEMBERED = 300_000
_known: dict[bytes, int] = {}


def _hash(name: bytes) -> int:
    return xxhash.xxh3_64_intdigest(name) % FEATURES


def _word_code(word: bytes) -> int:
    """Feature number of the lower-cased word without marks, with its shape flags above it."""
    core = word.strip(_ENDS)
    flags = 0
    for i, shape in enumerate(_SHAPES):
        flags |= (shape in word) << i
    flags |= (len(core) > 1 and core.isascii() and core.isupper()) << len(_SHAPES)
    flags |= (len(core) > 25) << len(_SHAPES) + 1
    return flags * FEATURES + _hash(b"w" + core.lower())


def text_features(text: bytes | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text: its words, and steps that the shares of
    marked, upper-case, very long and repeated words reach. A null text has only a sign for that.
    """
    found = words(text)
    if not found:
        return np.array([_hash(b"no words")])
    hold(_known)
    try:
        codes = np.fromiter(map(_known.__getitem__, found), np.int64, len(found))
    except KeyError:
        if len(_known) > _REMEMBERED:
            _known.clear()
        for word in set(found):
            if word not in _known:
                _known[word] = _word_code(word)
        codes = np.fromiter(map(_known.__getitem__, found), np.int64, len(found))
    names, flags = codes % FEATURES, codes // FEATURES
    shares = [float((flags >> i & 1).mean()) for i in range(len(_SHAPES) + 2)]
    shares.append(float((names[1:] == names[:-1]).mean()) if len(names) > 1 else 0.0)
    unique = np.unique(names)
    shares.append(1 - len(unique) / len(names))
    steps = [
        _hash(b"s%d>%d" % (i, k)) for i, share in enumerate(shares) for k, x in enumerate(_STEPS) if share > x
    ]
    steps.append(_hash(b"size%d" % len(found).bit_length()))
    return np.union1d(unique, np.array(steps, np.int64))


class Ordinal(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """One row per score, one column per grade."""
        upto = _sigmoid(self.thresholds[None, :] - np.asarray(score)[:, None])
        ones, zeros = np.ones((len(upto), 1)), np.zeros((len(upto), 1))
        return np.diff(np.hstack([zeros, upto, ones]), axis=1)

    def score(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(
    features: list[np.ndarray],
    grades: list[int],
    rounds: int = 250,
    rate: float = 0.3,
    sparsity: float = 0.05,
    least_rows: int = 10,
) -> Ordinal:
    """Full-batch adaptive gradient steps on the log loss; the same rows give the same model.

    Each step also shrinks the weights by ``sparsity`` over the root of the number of rows, so
    the many chance words of a corpus end at 0; features that fewer than ``least_rows`` rows
    have stay there. The thresholds are a first one and positive gaps (their logarithms are
    learned), so they stay ordered.
    """
    y = np.array(grades)
    top = int(y.max()) if len(y) else 1
    top = max(top, 1)
    weights = np.zeros(FEATURES)
    share = np.array([(y <= k).mean() if len(y) else (k + 1) / (top + 1) for k in range(top)])
    odds = np.log((share + 0.01) / (1.01 - share))
    first, gaps = odds[0], np.log(np.maximum(np.diff(odds), 0.05))
    if len(set(grades)) < 2:
        return Ordinal(weights, _thresholds(first, gaps))
    flat = np.concatenate(features)
    sizes = np.array([len(x) for x in features])
    counts = np.bincount(flat, minlength=FEATURES)
    used = np.flatnonzero(counts >= least_rows)
    number = np.full(FEATURES, -1)
    number[used] = np.arange(len(used))
    row = np.repeat(np.arange(len(y)), sizes)
    flat = number[flat]
    row, flat = row[flat >= 0], flat[flat >= 0]
    shrink = sparsity / np.sqrt(len(y))
    w = np.zeros(len(used))
    squares, bias_squares = np.full(len(used), 1e-8), np.full(top, 1e-8)
    for _ in range(rounds):
        cuts = _thresholds(first, gaps)
        score = np.bincount(row, weights=w[flat], minlength=len(y))
        padded = np.concatenate([[-np.inf], cuts, [np.inf]])
        low, high = _sigmoid(padded[y] - score), _sigmoid(padded[y + 1] - score)
        mass = np.maximum(high - low, 1e-9)
        d_low, d_high = low * (1 - low), high * (1 - high)
        slope = (d_high - d_low) / mass / len(y)
        gradient = np.bincount(flat, weights=slope[row], minlength=len(used))
        squares += gradient**2
        pace = rate / np.sqrt(squares)
        w -= pace * gradient
        w = np.sign(w) * np.maximum(np.abs(w) - pace * shrink, 0)
        pull = 1 / mass / len(y)
        by_cut = np.bincount(np.minimum(y, top - 1), weights=-pull * d_high * (y < top), minlength=top)
        by_cut += np.bincount(np.maximum(y - 1, 0), weights=pull * d_low * (y > 0), minlength=top)
        bias = np.array([by_cut.sum(), *(by_cut[k + 1 :].sum() * np.exp(gaps[k]) for k in range(top - 1))])
        bias_squares += bias**2
        step = rate * bias / np.sqrt(bias_squares)
        first, gaps = first - step[0], gaps - step[1:]
    weights[used] = w
    return Ordinal(weights, _thresholds(first, gaps))


def _thresholds(first: float, gaps: np.ndarray) -> np.ndarray:
    return first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


def grade_of(quality: Column, toxic: Column) -> Column:
    """0: poor, 1: fair text with toxic words, 2: good."""
    fair = F.when(F.coalesce(toxic, F.lit(0)) > 0, 1).otherwise(2)
    return F.when(quality > 0, fair).otherwise(0)


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ordinal:
    """Fit on at most ``sample`` labelled rows, those of least hash; null qualities are left out."""
    graded = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", grade_of(F.col("quality"), F.col("toxic")).alias("grade")
    )
    rated = least_rows(graded, F.xxhash64("doc_id"), sample, "doc_id", "grade")
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text")).join(
        F.broadcast(rated), "doc_id"
    )

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(x.as_py()).astype("<i4").tobytes() for x in batch.column("text")]
            columns = [batch.column("doc_id").cast(pa.int64()), batch.column("grade"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "grade", "features"])

    encoded = keep_texts(texts.mapInArrow(encode, "doc_id long, grade int, features binary"), "rated-features")
    rows = encoded.collect()
    rows.sort(key=lambda r: (r.doc_id, r.grade, bytes(r.features)))
    features = [np.frombuffer(r.features, "<i4").astype(np.int64) for r in rows]
    return fit(features, [r.grade for r in rows])


def grade_documents(documents: DataFrame, model: Ordinal, least_tail: float = LEAST_TAIL) -> DataFrame:
    """(doc_id, score, expected_grade, tail, kept) of each row from its whole text.

    ``tail`` is the probability of the best grade, ``kept`` says whether it reaches
    ``least_tail``. Null and empty texts are graded by the sign that stands for them.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(Ordinal(model.weights.astype(np.float32), model.thresholds))
    rows = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    out = rows.drop("text").schema
    for name in ("score", "expected_grade", "tail"):
        out = out.add(name, "double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            scores = np.array([held.score(text_features(x.as_py())) for x in batch.column("text")])
            chances = held.probabilities(scores)
            expected = chances @ np.arange(chances.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(expected), pa.array(chances[:, -1])],
                names=out.fieldNames(),
            )

    return rows.mapInArrow(run, out).withColumn("kept", F.col("tail") >= least_tail)


def classify_documents(documents: DataFrame, labels: DataFrame, key: Column | None = None) -> DataFrame:
    """Fit on the labelled rows and grade all documents; empty tables give no rows.

    Rows that repeat an id are graded one by one, each by its own text; all of them count in the
    fit if the id is labelled, once per label. ``key`` replaces ``doc_id`` in the result.
    """
    model = train(documents, labels)
    named = documents if key is None else documents.select(key.alias("doc_id"), "text")
    return keep_texts(grade_documents(named, model), "grades")
