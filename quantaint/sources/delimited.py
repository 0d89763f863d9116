"""The pipe-delimited relation files: text columns, a trailing separator, no header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaint.schema import RELATION_COLUMNS, columns_of
from quantaint.sources.database import Database

_FORMAT = {"sep": "|", "header": "false", "quote": ""}


def read_relation(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """Read text fields, then cast; a short row or a bad value is an error.

    The schema has one more field than the relation because rows end with a
    separator; it is never selected. Whole rows are parsed (no column pruning),
    otherwise a short row would pass as one with empty fields.
    """
    columns = columns_of(relation)
    fields = [f"c{i} string" for i in range(1, len(columns) + 2)]
    reader = spark.read.options(mode="FAILFAST", columnPruning="false", **_FORMAT)
    rows = reader.csv(path, schema=", ".join(fields))
    return rows.select(
        *[F.col(f"c{i}").cast(kind).alias(name) for i, (name, kind) in enumerate(columns, 1)]
    )


def read_database(spark: SparkSession, folder: str) -> Database:
    return Database(
        {rel: read_relation(spark, f"{folder}/{rel}.tbl", rel) for rel in RELATION_COLUMNS}
    )


def write_relation(df: DataFrame, path: str, relation: str) -> None:
    """Write a relation in its file layout; columns it lacks stay empty."""
    known = set(df.columns)
    fields = [
        (F.col(name) if name in known else F.lit(None)).cast("string").alias(name)
        for name, _ in columns_of(relation)
    ]
    df.select(*fields, F.lit(None).cast("string").alias("end")).write.csv(path, **_FORMAT)
