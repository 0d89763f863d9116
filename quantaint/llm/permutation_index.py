"""Approximate nearest neighbours by permutations of pivots.

A vector is represented by its nearest pivots in order. Blocks of vectors post
(vector, position) in one inverted file per pivot. A query reads the files of its own
nearest pivots only and ranks the block by Spearman's footrule with a location
parameter; the best of each block are ranked again by the true distance. Every block
is searched, so every vector is indexed and all that grows with the table is dealt out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantaint.llm.batches import least_rows

NEAREST = 10
PIVOTS = 256
# Nearest pivots that represent a vector.
PREFIX = 128
# Vectors that the pivots are chosen from: those of least hash.
PIVOT_SAMPLE = 4096
BLOCK, BLOCK_VALUES = 8192, 4_000_000
QUERIES = 1024
# Share of a block, and least number of vectors, that are ranked by the true distance.
RERANKED_SHARE, RERANKED_LEAST = 0.1, 500


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components finite."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def footrule_gain(files: list[tuple[np.ndarray, np.ndarray]], order: np.ndarray, n: int) -> np.ndarray:
    """What the common pivots take off the greatest footrule distance, halved, for ``n`` vectors.

    With missing pivots at the place L, the footrule of a query and a vector is a constant minus
    twice the sum of L - max(place in one, place in the other) over common pivots.
    """
    gain = np.zeros(n, np.int32)
    size = len(order)
    for place, pivot in enumerate(order):
        rows, places = files[pivot]
        gain[rows] += size - np.maximum(places, place)
    return gain


def _orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; ties to the first pivot."""
    far = (pivots**2).sum(1)[None, :] - 2 * vectors @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :prefix]


def inverted_files(orders: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, places) per pivot."""
    prefix = orders.shape[1]
    by_pivot = np.argsort(orders, axis=None, kind="stable")
    rows, places = by_pivot // prefix, (by_pivot % prefix).astype(np.int32)
    cuts = np.searchsorted(orders.ravel()[by_pivot], np.arange(1, pivots))
    return list(zip(np.split(rows, cuts), np.split(places, cuts), strict=True))


def search_block(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int
) -> list[tuple[int, int, float]]:
    """(query, vector, distance) of the ``k`` nearest found in a block sorted by id."""
    prefix = min(PREFIX, len(pivots))
    files = inverted_files(_orders(vectors, pivots, prefix), len(pivots))
    wanted = max(RERANKED_LEAST, ceil(RERANKED_SHARE * len(ids)))
    found = []
    for name, query, order in zip(query_ids, queries, _orders(queries, pivots, prefix), strict=True):
        gain = footrule_gain(files, order, len(ids))
        gain[ids == name] = -1
        if wanted < len(ids):
            # Equal gains go to the smaller ids, which stand first.
            least = np.partition(gain, len(ids) - wanted)[len(ids) - wanted]
            sure, even = np.flatnonzero(gain > least), np.flatnonzero(gain == least)
            best = np.concatenate([sure, even[: wanted - len(sure)]])
        else:
            best = np.arange(len(ids))
        best = best[ids[best] != name]
        distance = np.sqrt(((vectors[best] - query) ** 2).sum(axis=1))
        for i in np.lexsort((ids[best], distance))[:k]:
            found.append((int(name), int(ids[best[i]]), float(distance[i])))
    return found


def nearest_neighbours(
    embeddings: DataFrame,
    query_filter: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = NEAREST,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found to each row of ``query_filter``.

    Candidates are all rows but those with the query's own id; the score is the Euclidean
    distance in double precision, ties go to the smaller id. Rows without id, and vectors that
    are null, zero, not finite or of another length than most, take no part. An id that occurs
    several times asks once, with its least vector. No usable rows, no result.
    """
    spark = embeddings.sparkSession
    vector = F.col(vector_column).cast("array<double>")
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), vector.alias("vector"), query_filter.alias("q"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    most = lengths.orderBy(F.desc("rows"), "n").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if most is None:
        return empty
    width, count = most.n, most.rows
    rows = rows.filter(F.size("vector") == width)
    asked = rows.filter("q").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    query_count = asked.count()
    if query_count == 0:
        return empty
    drawn = least_rows(rows.select("vec_id", "vector"), F.xxhash64("vec_id"), PIVOT_SAMPLE, "vector")
    distinct = list(dict.fromkeys(tuple(r.vector) for r in drawn.collect()))[:PIVOTS]
    pivots = np.array(distinct)

    size = max(1, min(BLOCK, BLOCK_VALUES // width))
    blocks, chunks = ceil(count / size), ceil(query_count / QUERIES)
    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    posted = rows.select(
        "vec_id", "vector", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("block")
    ).select(every, "block", F.lit(False).alias("asks"), "vec_id", "vector")
    asking = asked.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.lit(True).alias("asks"),
        "vec_id",
        "vector",
    )
    both = posted.unionByName(asking).repartition("chunk", "block")
    grouped = both.sortWithinPartitions("chunk", "block", "asks", "vec_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(parts: list[tuple]) -> pa.RecordBatch:
            ids, vectors, asks = (np.concatenate(x) for x in zip(*parts, strict=True))
            found = search_block(ids[~asks], vectors[~asks], ids[asks], vectors[asks], pivots, k) if (~asks).any() else []
            columns = list(zip(*found, strict=True)) or [[], [], []]
            kinds = (pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "score"]
            )

        at, parts = None, []
        for batch in batches:
            chunk, block = (batch.column(c).to_numpy() for c in ("chunk", "block"))
            key = chunk.astype(np.int64) * blocks + block
            ids = batch.column("vec_id").to_numpy()
            vectors = batch.column("vector").flatten().to_numpy().reshape(-1, width)
            asks = batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            cuts = np.flatnonzero(np.diff(key)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                if a == b:
                    continue
                if parts and key[a] != at:
                    yield finish(parts)
                    parts = []
                at = key[a]
                parts.append((ids[a:b], vectors[a:b], asks[a:b]))
        if parts:
            yield finish(parts)

    found = grouped.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
