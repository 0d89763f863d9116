"""A set of named relations together with their row counts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from quantaint.schema import DEALT

# Rows of a bucket: fewer are not worth a task, more would spill.
LEAST_ROWS = 25_000
MOST_ROWS = 1_000_000


class Database(Mapping[str, DataFrame]):
    def __init__(self, tables: Mapping[str, DataFrame], parts: int = 0):
        self._tables = dict(tables)
        self._rows: dict[str, int] = {}
        self._parts = parts

    def __getitem__(self, relation: str) -> DataFrame:
        return self._tables[relation]

    def __iter__(self) -> Iterator[str]:
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    @property
    def spark(self) -> SparkSession:
        return next(iter(self._tables.values())).sparkSession

    def rows(self, relation: str) -> int:
        """Row count, asked once; for file-backed tables it comes from metadata."""
        if relation not in self._rows:
            self._rows[relation] = self._tables[relation].count()
        return self._rows[relation]

    @property
    def parts(self) -> int:
        """Buckets of all tables that are dealt by a key; asked of the largest relation unless given."""
        if not self._parts:
            self._parts = bucket_count(self.spark, max(self.rows(r) for r in DEALT if r in self))
        return self._parts

    def replacing(self, **tables: DataFrame) -> Database:
        return Database({**self._tables, **tables}, self._parts)


def bucket_count(spark: SparkSession, rows: int) -> int:
    """As many buckets as a shuffle has partitions, less for few rows and more for very many."""
    return max(1, rows // MOST_ROWS, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // LEAST_ROWS))
