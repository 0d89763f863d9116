"""Best-fit decreasing packing of documents into sequences of a fixed length.

Documents of equal length are interchangeable, so the decisions depend only on
how many pieces each length has: at most ``capacity`` numbers, whatever the size
of the corpus. From these counts the driver replays best-fit decreasing, each
time finding the tightest open bin by a segment tree over remaining capacities,
for whole runs of equal bins at once. The outcome is a short table (length, range
of ranks) -> (first sequence, offset); the pieces are ranked within their length
in salted groups and look up their place in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantaint.llm.batches import keep_texts
from quantaint.llm.tokens import encoder, token_bytes
from quantaint.sources.store import keep

CAPACITY = 2048
# Pieces of one length that a task ranks at once; larger lengths are dealt over more groups.
RANKED_ROWS = 200_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLAN = "length long, rank_from long, rank_to long, first_bin long, per_bin long, base long"


def token_pieces(
    documents: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document.

    Whole texts are encoded and ``end_id`` is appended; a null text counts as empty.
    Only documents above ``capacity`` are cut: the first piece takes the remainder,
    all others are full. Repeated rows yield their pieces again.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = _PIECES + (", ids binary" if with_ids else "")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = token_bytes(end_id)
        for batch in batches:
            out: list[tuple] = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode.encode(text.as_py()) + end
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                start, size, piece = 0, first, 0
                while start < n:
                    own = ids[4 * start : 4 * (start + size)]
                    row = (name, piece, start, size, zlib.crc32(own))
                    out.append((*row, own) if with_ids else row)
                    start, size, piece = start + size, capacity, piece + 1
            if out:
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.binary()]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)],
                    names=[x.split()[0] for x in schema.split(", ")],
                )

    return rows.mapInArrow(cut, schema)


class OpenBins:
    """Runs of equal open bins by remaining capacity, under a segment tree of counts."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self._filled = np.zeros(2 * self.leaves, dtype=np.int64)
        self._runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, first_bin: int, count: int) -> None:
        """``count`` bins from number ``first_bin`` on have ``left`` places free."""
        if left == 0 or count == 0:
            return
        self._runs[left].append((first_bin, count))
        self._count(left, 1)

    def take(self, left: int) -> tuple[int, int]:
        run = self._runs[left].pop()
        self._count(left, -1)
        return run

    def _count(self, left: int, by: int) -> None:
        node = self.leaves + left
        while node:
            self._filled[node] += by
            node //= 2

    def tightest(self, length: int) -> int | None:
        """Least remaining capacity of at least ``length``: up, then down one path of the tree."""
        node = self.leaves + length
        if self._filled[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self._filled[node + 1]:
                node += 1
                while node < self.leaves:
                    node *= 2
                    if not self._filled[node]:
                        node += 1
                return node - self.leaves
            node //= 2
        return None


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Rows of the plan: ranks [from, to) of a length go ``per_bin`` each to bins from ``first_bin`` on.

    The same result as placing piece after piece: the tightest bin that takes a piece
    stays the tightest as long as it takes another of the same length.
    """
    bins = OpenBins(capacity)
    plan: list[tuple[int, ...]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, total = 0, counts[length]
        while rank < total:
            left = bins.tightest(length)
            if left is None:
                left = capacity
                first, count = opened, ceil((total - rank) / (capacity // length))
                opened += count
            else:
                first, count = bins.take(left)
            per_bin = left // length
            full = min(count, (total - rank) // per_bin)
            if full:
                plan.append((length, rank, rank + full * per_bin, first, per_bin, capacity - left))
                bins.add(left - per_bin * length, first, full)
                rank += full * per_bin
            some = total - rank
            if full < count and some:
                plan.append((length, rank, total, first + full, some, capacity - left))
                bins.add(left - some * length, first + full, 1)
                rank, full = total, full + 1
            bins.add(left, first + full, count - full)
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, ranked_rows: int = RANKED_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table with ``length`` (1 to ``capacity``).

    The table is read twice (counts, ranks), so pass a stored one. Rows are ranked by
    ``doc_id`` and ``piece`` where present; which of several equal rows goes where does not matter.
    """
    spark = pieces.sparkSession
    rows = pieces.count()
    salts = max(1, ceil(rows / ranked_rows))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    dealt = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = keep(dealt.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "length-counts")
    counts = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("_n")).collect()}
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    plan = spark.createDataFrame(best_fit_plan(counts, capacity), _PLAN)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order))
    ranked = (
        dealt.withColumn("_local", local - 1)
        .join(shifts, ["length", "_salt"])
        .withColumn("_rank", F.col("_local") + F.col("_shift"))
    )
    p = F.broadcast(plan.withColumnRenamed("length", "_length"))
    inside = F.col("_rank") - F.col("rank_from")
    return ranked.join(
        p,
        (F.col("length") == F.col("_length"))
        & (F.col("_rank") >= F.col("rank_from"))
        & (F.col("_rank") < F.col("rank_to")),
    ).select(
        *pieces.columns,
        (F.col("first_bin") + F.floor(inside / F.col("per_bin"))).alias("sequence_id"),
        (F.col("base") + F.pmod(inside, F.col("per_bin")) * F.col("length")).alias("offset"),
    )


def pack_documents(
    documents: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY
) -> DataFrame:
    """Cut and pack all documents; an empty table gives no rows."""
    pieces = keep_texts(token_pieces(documents, tokenizer, end_id, capacity), "token-pieces")
    return pack(pieces, capacity)


def sequence_ids(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids): the ids of each sequence, from pieces packed ``with_ids``.

    A sequence has at most ``capacity`` ids, so the gathered list is bounded.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(
        F.count(F.lit(1)).alias("n_pieces"), joined.alias("ids")
    )
