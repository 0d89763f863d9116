"""Stages that hand whole texts to Python, in batches whose memory stays small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantaint.sources.store import keep

_held = None


def hold(memory) -> None:
    """Make ``memory`` the one word memory of this worker process.

    Workers outlive a stage: what another operator has remembered is emptied first.
    """
    global _held
    if _held is not memory:
        if _held is not None:
            _held.clear()
        _held = memory


def least_rows(rows: DataFrame, draw: Column, number: int, *ties: str) -> DataFrame:
    """The ``number`` rows of least ``draw`` (a uniform bigint hash), then of least ``ties``.

    Twice as many rows as wanted are drawn by their hash alone, so what tasks send to the driver
    does not grow with their number. Only where rows share so few hashes that these do not
    suffice are all rows ordered.
    """
    total = rows.count()
    rows = rows.withColumn("_least", draw)
    if total > 4 * number:
        near = keep(rows.filter(F.col("_least") < -(2**63) + 2**64 * 2 * number // total), "drawn-rows")
        if near.count() >= number:
            rows = near
    return rows.orderBy("_least", *ties).limit(number).drop("_least")


_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Rows of one batch; batches of long texts are cut earlier by Spark's own limit of bytes.
ROWS = 1000


def keep_texts(df: DataFrame, label: str) -> DataFrame:
    """``keep`` for a stage with Python functions over texts: few rows a batch while it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_SETTING)
    conf.set(_SETTING, str(ROWS))
    try:
        return keep(df, label)
    finally:
        conf.set(_SETTING, before)
