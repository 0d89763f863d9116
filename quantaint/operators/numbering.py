"""Row numbers per group without gathering a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantaint.sources.store import keep


def number_rows(df: DataFrame, groups: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out`` = 1, 2, … per group in ``order``; no groups: over all rows.

    Rows are dealt in ranges of (group, order), so that a group of any size spreads over
    as many pieces as its rows need. A row's number is its place within the piece plus
    the group's rows in earlier pieces: two levels of sums, the second over one row per
    (group, piece). Ties are numbered in any order; null is a group and sorts first.

    The sorted rows are written because piece boundaries are sampled: a second evaluation
    could cut elsewhere.
    """
    key = [*groups, *order]
    sorted_rows = keep(
        df.repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .withColumn("_piece", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id()),
        "range-sorted",
    )
    heads = sorted_rows.groupBy(*groups, "_piece").agg(
        F.min("_local").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    # A group has at most one head per piece.
    before = Window.partitionBy(*groups).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = heads.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        F.col("_piece").alias("_p"),
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)],
        F.col("_piece") == F.col("_p"),
    )
    return sorted_rows.join(shifts, same).select(
        *df.columns, (F.col("_local") + F.col("_shift")).cast("bigint").alias(out)
    )
