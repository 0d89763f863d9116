"""Importance resampling of documents towards the words of a target text.

A pre-tokeniser of the tokenizers library, an untrained regex split, cuts the text into words
with their offsets; pairs of offsets bound the windows of words, and every window falls into a
bucket by CRC-32. Documents and target texts are two histograms over the buckets; a bucket's gain
is the log of their ratio. A document weighs the mean gain of its windows, and adding Gumbel noise
to the weights makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from quantaint.llm.batches import hold, keep_texts
from quantaint.operators.numbering import number_rows
from quantaint.sources.store import keep

# A-Z are lower-cased before, so the gap between digits and small letters is no part of a word.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# A longer text is cut at gaps into parts of about this many characters.
_PART = 1 << 20
# Distinct features a worker remembers.
_REMEMBERED = 300_000


def code_type(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def ascii_lower(text: str) -> str:
    return text.encode().lower().decode()


def _parts(text: str, width: int) -> Iterator[str]:
    """The text in parts that end in a gap; each repeats the last ``width - 1`` words of the one before."""
    start = at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _PART)
        if gap is None:
            yield text[start:]
            return
        yield text[start : gap.end()]
        at = start = gap.end()
        for _ in range(width - 1):
            while start and _GAP.match(text[start - 1]):
                start -= 1
            while start and not _GAP.match(text[start - 1]):
                start -= 1


class Features:
    """All runs of 1 to ``width`` consecutive words of a text, as bucket numbers."""

    def __init__(self, width: int, buckets: int) -> None:
        self.width, self.buckets, self.code = width, buckets, code_type(buckets)
        self.split = Split(Regex(WORD), "removed", invert=True)
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> tuple[int, np.ndarray]:
        """(number of words, bucket of every feature)."""
        if not text:
            return 0, np.zeros(0, self.code)
        hold(self.known)
        words, found = 0, []
        repeated = 0
        for part in _parts(ascii_lower(text), self.width):
            cut = self.split.pre_tokenize_str(part)
            words += len(cut) - repeated
            for n in range(1, self.width + 1):
                # Windows that lie wholly in the repeated words were counted in the part before.
                first = max(0, repeated - n + 1)
                found.append(self._buckets(part, cut[first:], n))
            repeated = min(self.width - 1, words)
        return words, np.concatenate(found)

    def _buckets(self, part: str, cut: list[tuple[str, tuple[int, int]]], n: int) -> np.ndarray:
        if n == 1:
            runs = [word for word, _ in cut]
        else:
            ends = cut[n - 1 :]
            runs = [_GAP.sub(" ", part[a:b]) for (_, (a, _)), (_, (_, b)) in zip(cut, ends)]
        try:
            return np.fromiter(map(self.known.__getitem__, runs), self.code, len(runs))
        except KeyError:
            pass
        if len(self.known) > _REMEMBERED:
            self.known.clear()
        for run in set(runs):
            if run not in self.known:
                self.known[run] = crc32(run.encode()) % self.buckets
        return np.fromiter(map(self.known.__getitem__, runs), self.code, len(runs))


_CODED = "n_words long, n_features long, codes binary"


def coded_features(texts: DataFrame, kept: list[str], width: int, buckets: int) -> DataFrame:
    """``kept`` columns of ``texts`` with its words counted and its features as buckets (``code_type``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(width, buckets)
        for batch in batches:
            words, counts, codes = [], [], []
            for text in batch.column(len(kept)):
                n, found = features.of(text.as_py())
                words.append(n)
                counts.append(len(found))
                codes.append(found.tobytes())
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [pa.array(words, pa.int64()), pa.array(counts, pa.int64()), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_words", "n_features", "codes"])

    narrow = texts.select(*kept, F.col("text").cast("string").alias("text"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, head + _CODED)


def bucket_counts(coded: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): a histogram per task, summed by bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for codes in batch.column(0):
                total += np.bincount(np.frombuffer(codes.as_py(), code_type(buckets)), minlength=buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], names=["bucket", "n"])

    parts = coded.select("codes").mapInArrow(run, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int, scale: int = 1000) -> DataFrame:
    """(bucket, gain) for every bucket, from two histograms; both are smoothed by one per bucket."""
    spark = documents.sparkSession
    both = (
        spark.range(buckets)
        .withColumnRenamed("id", "bucket")
        .join(documents.withColumnRenamed("n", "s"), "bucket", "left")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    )
    all_s, all_t = (F.sum(c).over(Window.partitionBy()) for c in ("s", "t"))
    ratio = (F.col("t") + 1) * (all_s + buckets) / ((F.col("s") + 1) * (all_t + buckets))
    return both.select("bucket", F.floor(scale * F.log(ratio)).alias("gain"))


def gumbel(doc_id: Column, seed: str, scale: int = 1000) -> Column:
    """Noise of a document by its id: floor of ``scale`` times a Gumbel value; a null id is an empty string."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    documents: DataFrame,
    target: DataFrame,
    width: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: str = "2024",
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of ``documents``.

    ``rank`` counts the drawn rows from 1; others have none. Of the rows with ``least_words`` words
    or more, ``percent`` in a hundred are drawn: the highest scores, ties to smaller ids, a null id
    first. Null and empty texts have no features and weight 0. Repeated rows have equal scores and
    ranks of their own. A text of any length counts whole. Without documents there are no rows;
    without target texts all gains follow from the documents alone. Only ``doc_id`` and ``text``
    are read, whatever other columns there are.
    """
    coded = keep_texts(coded_features(documents, ["doc_id"], width, buckets), "resample-features")
    aimed = coded_features(target, [], width, buckets)
    # At most ``buckets`` rows, a parameter.
    gained = bucket_gains(bucket_counts(coded, buckets), bucket_counts(aimed, buckets), buckets).collect()
    gains = np.zeros(buckets, np.int64)
    gains[[r.bucket for r in gained]] = [r.gain for r in gained]

    def weigh(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_py(), code_type(buckets)) for x in batch.column("codes")]
            weights = [int(gains[x].sum()) // len(x) if len(x) else 0 for x in found]
            columns = [batch.column(c) for c in ("doc_id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(weights, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"]
            )

    id_type = coded.schema["doc_id"].dataType.simpleString()
    weighed = coded.select("doc_id", "n_words", "n_features", "codes").mapInArrow(
        weigh, f"doc_id {id_type}, n_words long, n_features long, weight long"
    )
    scored = keep(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "resample-scores")
    open_rows = scored.filter(F.col("n_words") >= least_words)
    drawn = percent * open_rows.count() // 100
    placed = number_rows(open_rows.withColumn("_below", -F.col("score")), [], ["_below", "doc_id"], "place")
    rank = F.when(F.col("place") <= drawn, F.col("place"))
    columns = ["doc_id", "n_features", "weight", "score"]
    rest = scored.filter(F.col("n_words") < least_words)
    return placed.select(*columns, rank.alias("rank")).unionByName(
        rest.select(*columns, F.lit(None).cast("long").alias("rank"))
    )
