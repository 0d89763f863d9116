"""Quality rules whose cutoffs follow each language's and source's own distribution.

Every text is measured once. Each measure goes into a mergeable quantile sketch per
(language, source): counts in logarithmic buckets, which bound the relative error of a
quantile and merge by addition, so Spark pre-aggregates them before the shuffle. A group's sketch is
merged with its language's at a fixed small weight, and the language's with that of all
texts, so a group of few documents leans on its parent. From the merged sketches come
fences, the upper quartile times a power of its ratio to a low quantile; the measured
texts are then joined with the fences of their group and filtered. No fence holds a
constant in the unit of its measure.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from math import log
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaint.llm.batches import keep_texts
from quantaint.llm.shingles import words
from quantaint.sources.store import keep

_BLANKS = b" \t\n\x0b\x0c\r"
_TRAILING = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
WINDOW = 8
# Relative error of a quantile taken from a sketch.
ERROR = 0.01


class Fence(NamedTuple):
    """``measure`` may exceed its upper quartile by ``spread`` times that quartile's distance from the lowest twentieth.

    Distances are of logarithms. Junk in up to a quarter of a group leaves the quartile where it is,
    copies of one text in up to seven tenths of it leave a distance.
    """

    measure: str
    spread: float


FENCES = (
    Fence("symbols_per_word", 1.5),
    Fence("dup_line_share", 1.5),
    Fence("repeat_share", 1.5),
    Fence("chars_per_word", 2.5),
)
# Documents that a parent's sketch counts for in each of its groups.
PARENT_DOCUMENTS = 50


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """The numbers named in ``_COUNTS`` of a whole text; null: zeros.

    Lines are cut at line feeds and count if they have a word.
    """
    if not text:
        return (0,) * len(_COUNTS)
    found = words(text)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return (
        len(found),
        len(text.translate(None, _BLANKS + _TRAILING)),
        len(text) - len(text.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(found),
        len(lines),
    )


def repeated_words(found: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur twice or more, first ones included.

    Windows are named exactly by doubling: equal pairs get equal numbers, then pairs of pairs.
    """
    n = len(found) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    names = np.fromiter((numbers.setdefault(w, len(numbers)) for w in found), np.int64, len(found))
    if len(numbers) == len(found):
        return 0
    size = 1
    while size < width:
        pairs = names[:-size] * (int(names.max()) + 1) + names[size:]
        names = np.unique(pairs, return_inverse=True)[1]
        size *= 2
    twice = np.bincount(names)[names] > 1
    inside = np.zeros(len(found) + 1, np.int64)
    np.add.at(inside, np.flatnonzero(twice), 1)
    np.add.at(inside, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(inside)[:-1] > 0).sum())


def measure_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, lang, source) with the counts of each row; texts are not carried on."""
    rows = documents.select("doc_id", "lang", "source", F.col("text").cast("binary").alias("text"))
    schema = rows.drop("text").schema
    for name in _COUNTS:
        schema = schema.add(name, "long")

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [text_counts(x.as_py()) for x in batch.column("text")]
            columns = np.array(counts, np.int64).reshape(-1, len(_COUNTS)).T
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["doc_id", "lang", "source"]).columns, *map(pa.array, columns)],
                names=schema.fieldNames(),
            )

    return rows.mapInArrow(measure, schema)


def base_failed() -> Column:
    few = F.col("n_words") < 20
    return few | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _with_measures(counts: DataFrame) -> DataFrame:
    """Shares count one more of what is rare, so that a text without it lies lower the longer it is."""
    def share(part: str, whole: str) -> Column:
        return (F.col(part) + 1) / (F.col(whole) + 1)

    return counts.select(
        "*",
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        (F.col("word_chars") / F.greatest("n_words", F.lit(1))).alias("chars_per_word"),
    )


def quantile_sketches(measured: DataFrame, groups: list[str], measures: list[str]) -> DataFrame:
    """(groups, measure, bucket, n): bucket 0 holds zeros, bucket b values near gamma^b.

    Sketches of parts of the data merge by adding ``n`` of equal buckets.
    """
    gamma = log((1 + ERROR) / (1 - ERROR))
    # Measures lie far above 1e-9, so shifted buckets are positive.
    buckets = F.array(
        *[
            F.struct(
                F.lit(m).alias("measure"),
                F.when(F.col(m) <= 1e-9, 0)
                .otherwise(F.ceil(F.log(F.col(m) * 1e9) / gamma))
                .cast("int")
                .alias("bucket"),
            )
            for m in measures
        ]
    )
    return (
        measured.select(*groups, F.explode(buckets).alias("_b"))
        .groupBy(*groups, "_b.measure", "_b.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merge_sketches(sketches: DataFrame, groups: list[str]) -> DataFrame:
    return sketches.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketches: DataFrame, groups: list[str], levels: dict[str, float]) -> DataFrame:
    """(groups, measure, n, one column per level) from merged sketches.

    A sketch has a bounded number of buckets, so the windows are small.
    """
    key = [*groups, "measure"]
    up_to = Window.partitionBy(*key).orderBy("bucket")
    ranked = sketches.withColumn("_upto", F.sum("n").over(up_to)).withColumn(
        "_all", F.sum("n").over(Window.partitionBy(*key))
    )
    gamma = log((1 + ERROR) / (1 - ERROR))
    value = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(
        F.exp(F.col("bucket") * gamma) * (1 - ERROR) * 1e-9
    )
    return ranked.groupBy(*key).agg(
        F.max("_all").alias("n"),
        *[
            F.min(F.when(F.col("_upto") >= F.col("_all") * q, value)).alias(name)
            for name, q in levels.items()
        ],
    )


def lean_on_parent(sketches: DataFrame, parent: DataFrame, groups: list[str], shared: list[str]) -> DataFrame:
    """``sketches`` by ``groups`` with their parent's, by ``shared``, added as ``PARENT_DOCUMENTS`` documents."""
    whole = Window.partitionBy(*shared, "measure")
    share = parent.withColumn("n", PARENT_DOCUMENTS * F.col("n") / F.sum("n").over(whole))
    measures = sketches.select(*groups, "measure").distinct()
    added = _join_null_safe(measures, share, [*shared, "measure"])
    columns = [*groups, "measure", "bucket", "n"]
    return merge_sketches(sketches.select(*columns).unionByName(added.select(*columns)), groups)


def group_fences(sketches: DataFrame, fences: tuple[Fence, ...]) -> DataFrame:
    """(lang, source, a fence per measure) from sketches by language and source."""
    groups = ["lang", "source"]
    by_lang = lean_on_parent(merge_sketches(sketches, ["lang"]), merge_sketches(sketches, []), ["lang"], [])
    cuts = sketch_quantiles(
        lean_on_parent(sketches, by_lang, groups, ["lang"]), groups, {"low": 0.05, "upper": 0.75}
    )
    # Quantiles of a sketch may lie too low by its error.
    error = (1 + ERROR) / (1 - ERROR)

    def fence(f: Fence) -> Column:
        cut = F.col("upper") * F.pow(F.col("upper") / F.col("low"), F.lit(f.spread)) * error
        return F.max(F.when(F.col("measure") == f.measure, cut)).alias(f"most_{f.measure}")

    return cuts.groupBy(*groups).agg(*map(fence, fences))


def apply_rules(documents: DataFrame, fences: tuple[Fence, ...] = FENCES) -> DataFrame:
    """Counts and verdicts per document: (doc_id, counts, base_failed, kept, failed).

    A document is kept if the base rules pass and no measure lies above the fence of its
    (lang, source); ``failed`` names the measures that do. Null languages and sources are
    groups of their own; a null text counts as one without words and fails the base rules.
    Fences come from the documents that pass the base rules; each repeated row counts. Whole
    texts are measured, however long. Empty tables give no rows. Other columns are not read.
    ``doc_id`` may be of any type; it is carried through.
    """
    counts = keep_texts(measure_texts(documents), "text-counts")
    measured = _with_measures(counts).withColumn("base_failed", base_failed())
    groups = ["lang", "source"]
    names = [f.measure for f in fences]
    sketches = keep(
        quantile_sketches(measured.filter(~F.col("base_failed")), groups, names), "quantile-sketches"
    )
    limits = keep(group_fences(sketches, fences), "fences")
    joined = _join_null_safe(measured, limits, groups)
    above = [F.when(F.col(name) > F.col(f"most_{name}"), F.lit(name)) for name in names]
    failed = F.array_compact(F.array(*above))
    return joined.select(
        "doc_id",
        *_COUNTS[:5],
        "base_failed",
        (~F.col("base_failed") & (F.size(failed) == 0)).alias("kept"),
        "n_lines",
        failed.alias("failed"),
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, "left").drop(*[f"_r_{k}" for k in keys])
