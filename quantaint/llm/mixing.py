"""Mixing sources to target weights by balanced (cube method) sampling.

A source's documents are each taken the same number of times on average, target size
over source size. The whole part is certain; the fraction is an inclusion probability
that the cube method turns into a yes or no: a flight moves three probabilities at a
time along the null space of the constraints (number of documents, total size) until
one of them is 0 or 1. Sources are flown in bounded blocks; at most two open documents
of each block meet in the next level, until one block a source is left. There the last two
are drawn by their chances, and where that leaves the total off its target by more than a small
share, which takes a source of few documents, some documents are turned round to make up for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import ceil
from random import Random
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaint.sources.store import keep

WEIGHTS = (1, 2, 3)
LARGEST_FACTOR = 3
# Documents in one flight; larger sources fly in several blocks.
BLOCK = 20_000
_WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9
_SMALLEST = 200
# A source's total may miss its target by this share.
NEAR = 0.005


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def row_hash() -> Column:
    """Names a row by id, source and text."""
    return F.xxhash64("doc_id", "source", "text")


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, largest_factor: int = LARGEST_FACTOR
) -> DataFrame:
    """(source, n_docs, source_size, target) of a table with ``source`` and ``size``.

    Sources in order of code points, null last, take the weights in turn and share the total.
    A target stops at ``largest_factor`` times its source; what is over is shared anew by
    weight. That fills all sources to one level per weight unit: sorted by the level at which
    they are full, the first k are full and the rest share what remains.
    """
    totals = sizes.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")
    )
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turns = F.array(*[F.lit(w) for w in weights])
    weighted = totals.withColumn(
        "_w", F.element_at(turns, (F.pmod(F.row_number().over(by_name) - 1, len(weights)) + 1))
    ).withColumn("_cap", F.col("source_size") * largest_factor)
    everything = Window.partitionBy()
    order = [F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        weighted.withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_left", F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn(
            "_weight", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
        )
        .withColumn("_level", F.col("_left") / F.col("_weight"))
        # The first source that is not full at its own level sets the level for all after it.
        .withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
        .withColumn(
            "_final",
            F.first(F.when(F.col("_open"), F.col("_level")), ignorenulls=True).over(
                Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            ),
        )
        .select(
            "source",
            "n_docs",
            "source_size",
            F.least(
                F.col("_cap").cast("double"),
                F.coalesce(F.col("_final") * F.col("_w"), F.col("_cap").cast("double")),
            ).alias("target"),
        )
    )


def flight(chance: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """Move probabilities until at most two lie strictly between 0 and 1.

    Both sums, of ``chance`` and of ``chance * size``, stay as they are. The direction of a move
    is drawn with chances inverse to its room, so that each unit keeps its probability on average;
    the draws follow from ``seed``, so reruns agree.
    """
    draw = Random(seed).random
    p = [float(x) for x in chance]
    s = [float(x) for x in size]
    held: list[int] = []
    for i, x in enumerate(p):
        if not _EPS < x < 1 - _EPS:
            p[i] = round(x)
            continue
        held.append(i)
        while len(held) > 2:
            a, b, c = held
            # The null space of ((1, 1, 1), (sa, sb, sc)).
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = min(_room(p[j], v) for j, v in zip(held, u, strict=True))
            down = min(_room(p[j], -v) for j, v in zip(held, u, strict=True))
            step = up if draw() * (up + down) < down else -down
            for j, v in zip(held, u, strict=True):
                p[j] = min(1.0, max(0.0, p[j] + step * v))
            for j in held:
                if not _EPS < p[j] < 1 - _EPS:
                    p[j] = float(round(p[j]))
            held = [j for j in held if 0.0 < p[j] < 1.0]
    return np.array(p)


def _room(p: float, v: float) -> float:
    if v > 0:
        return (1 - p) / v
    return p / -v if v < 0 else float("inf")


def landing(chance: np.ndarray, size: np.ndarray, seed: int = 0, near: float = NEAR, flips: int = 8) -> np.ndarray:
    """Round the units the flight left open, each drawn by its chance from ``seed``.

    If the total size then misses by more than the share ``near``, decided units are turned round, in
    up to ``flips`` steps: each time the one, or the two of the smallest, that bring the total nearest.
    """
    p = chance.copy()
    wanted = float((p * size).sum())
    draw = Random(seed).random
    for i in np.flatnonzero((p > 0) & (p < 1)):
        p[i] = float(draw() < p[i])
    pool = np.argsort(size, kind="stable")[:_SMALLEST]
    for _ in range(flips):
        missing = wanted - float((p * size).sum())
        if abs(missing) <= near * wanted:
            break
        change = size * (1 - 2 * p)
        one = int(np.argmin(np.abs(missing - change)))
        turned, best = [one], abs(missing - change[one])
        pairs = np.abs(missing - change[pool][:, None] - change[pool][None, :])
        np.fill_diagonal(pairs, np.inf)
        a, b = divmod(int(np.argmin(pairs)), len(pool)) if len(pool) > 1 else (0, 0)
        if a != b and pairs[a, b] < best:
            turned, best = [pool[a], pool[b]], pairs[a, b]
        if best >= abs(missing) - _EPS:
            break
        p[turned] = 1 - p[turned]
    return p


_FLOWN = "_uid long, _block string, size long, chance double"


def _fly(rows: DataFrame, last: bool) -> DataFrame:
    """Fly each ``_block``; rows come sorted, so a block is gathered from a stream."""
    ordered = rows.repartition("_block").sortWithinPartitions("_block", "row_hash", "_uid")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(name: str, parts: list[tuple]) -> pa.RecordBatch:
            uid, size, chance = (np.concatenate(x) for x in zip(*parts, strict=True))
            seed = crc32(size.tobytes(), crc32(chance.tobytes(), crc32(name.encode())))
            done = flight(chance, size, seed)
            if last:
                done = landing(done, size, seed)
            return pa.RecordBatch.from_arrays(
                [pa.array(uid), pa.array([name] * len(uid), pa.string()), pa.array(size), pa.array(done)],
                names=["_uid", "_block", "size", "chance"],
            )

        at, parts = None, []
        for batch in batches:
            names = batch.column("_block").to_pylist()
            values = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_uid", "size", "chance")]
            first = 0
            for i in range(len(names) + 1):
                if i == len(names) or names[i] != names[first]:
                    if i > first:
                        if parts and names[first] != at:
                            yield finish(at, parts)
                            parts = []
                        at = names[first]
                        parts.append(tuple(v[first:i] for v in values))
                    first = i
        if parts:
            yield finish(at, parts)

    return ordered.mapInArrow(run, _FLOWN)


def mix_sources(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    largest_factor: int = LARGEST_FACTOR,
    size: Callable[[Column], Column] = word_count,
    block: int = BLOCK,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, times, row_hash) of each document row, and the columns ``also``.

    ``taken`` is ``times * size``; ``row_hash`` is xxhash64 of id, source and text. A source of
    size 0 has target 0 and nothing is taken. Repeated rows are units of their own; a null source is a source. The order of a flight is by hash of
    the row, so reruns agree. An empty table gives no rows.
    """
    sized = keep(
        documents.select(
            "doc_id",
            "source",
            size(F.col("text")).alias("size"),
            row_hash().alias("row_hash"),
            *also,
        ),
        "document-sizes",
    )
    targets = keep(source_targets(sized, weights, largest_factor), "source-targets")
    joined = sized.join(
        targets.select(F.col("source").alias("_s"), "n_docs", "source_size", "target"),
        F.col("source").eqNullSafe(F.col("_s")),
    ).drop("_s")
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Rows keep a number of their own from here on, as the table is stored with it.
    units = keep(
        joined.withColumns(
            {
                "_whole": F.floor(factor + _EPS),
                "_chance": F.greatest(factor - F.floor(factor + _EPS), F.lit(0.0)),
                "_uid": F.monotonically_increasing_id(),
            }
        ),
        "mix-units",
    )
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    blocks = F.ceil(F.col("n_docs") / block)
    name = F.concat(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")),
        F.lit("/"),
        F.pmod(F.col("row_hash"), blocks).cast("string"),
    )
    open_rows = units.filter((F.col("_chance") > _EPS) & (F.col("size") > 0)).select(
        "_uid", name.alias("_block"), "size", F.col("_chance").alias("chance"), "row_hash"
    )
    levels = []
    count = ceil(largest / block)
    while True:
        flown = keep(_fly(open_rows, last=count <= 1), "flight")
        landed = flown.filter((F.col("chance") <= 0) | (F.col("chance") >= 1))
        levels.append(landed.filter(F.col("chance") >= 1).select("_uid"))
        if count <= 1:
            break
        # Two open units a block go on, with ``block / 2`` former blocks in each new one.
        merged = max(2, block // 2)
        count = ceil(count / merged)
        number = F.floor(F.regexp_extract("_block", r"/(\d+)$", 1).cast("long") / merged)
        open_rows = flown.filter((F.col("chance") > 0) & (F.col("chance") < 1)).select(
            "_uid",
            F.concat(F.regexp_replace("_block", r"/\d+$", ""), F.lit("/"), number.cast("string")).alias("_block"),
            "size",
            "chance",
            F.xxhash64("_uid").alias("row_hash"),
        )
    extra = levels[0]
    for level in levels[1:]:
        extra = extra.unionByName(level)
    times = F.col("_whole") + F.when(F.col("_one").isNotNull(), 1).otherwise(0)
    times = F.when(F.col("size") > 0, times).otherwise(0)
    return units.join(extra.withColumn("_one", F.lit(1)), "_uid", "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (times * F.col("size")).cast("long").alias("taken"),
        times.cast("int").alias("times"),
        "row_hash",
        *also,
    )
