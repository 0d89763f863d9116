"""Scenario-partitioned result tables: writing, reading one scenario, resuming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaint.operators.scenarios import Scenario, db_ids, split_db_id
from quantaint.schema import SCENARIO_COLUMNS


def write_table(
    df: DataFrame,
    path: str,
    extra: tuple[str, ...] = (),
    file_format: str = "parquet",
    gathered: bool = False,
) -> None:
    """Write under one folder per scenario (and per ``extra`` column); ``gathered`` rows are not shuffled."""
    folders = [*SCENARIO_COLUMNS, *extra]
    (df if gathered else by_folder(df, folders)).write.partitionBy(*folders).format(file_format).save(path)


def by_folder(df: DataFrame, folders: Sequence[str]) -> DataFrame:
    """Rows gathered by folder for writing: a large folder is dealt to as many tasks as its size
    asks for, small ones share a task, so that the number of files follows the size."""
    return df.hint("rebalance", *folders)


def write_in_order(df: DataFrame, path: str, order: Sequence[str], file_format: str = "parquet") -> None:
    """Write files that hold ``order`` within and from one to the next by name."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.format(file_format).save(path)


def read_table(
    spark: SparkSession,
    path: str,
    like: DataFrame,
    scenario: Mapping[str, str] | None = None,
    file_format: str = "parquet",
) -> DataFrame:
    """Read a written table; naming scenario labels reads only their folders."""
    df = spark.read.schema(like.schema).format(file_format).load(path)
    for column, value in (scenario or {}).items():
        df = df.filter(F.col(column) == value)
    return df.select(*like.columns)


def with_scenarios(df: DataFrame, scenarios: list[Scenario]) -> DataFrame:
    """Repeat scenario-independent rows under every scenario's labels."""
    repeated = df.select(F.explode(db_ids(scenarios)).alias("db_id"), "*")
    return split_db_id(repeated).drop("db_id")


def scenario_index(df: DataFrame) -> DataFrame:
    """The scenarios present in a result table."""
    return df.select(*SCENARIO_COLUMNS).distinct()


def pending_scenarios(wanted: DataFrame, done: DataFrame, force: bool = False) -> DataFrame:
    """Scenario ids still to be computed; ``force`` asks for all again."""
    ids = wanted.select("db_id").distinct()
    return ids if force else ids.join(done.select("db_id").distinct(), "db_id", "left_anti")


def discover_cases(spark: SparkSession, path: str, scales: Sequence[str] | None = None) -> DataFrame:
    """(scale, subset, ratio, seed, db_id) of the cases stored below ``path``, in order of ``db_id``.

    Only names are read, never rows. Folders are called ``sf…/subset…/<ratio>/seed…``, alone or as
    ``scale=sf…``; others are passed over, as are folders without files. ``scales`` chooses among
    the scales, and one that is not there gives no rows. Two writes in one case are an error, as
    it would be unclear which holds.
    """
    parts = [r"(?:scale=)?(sf[^/]*)", r"(?:subset=)?(subset[^/]*)", r"(?:ratio=)?([^/]+)", r"(?:seed=)?(seed[^/]*)"]
    pattern = "/" + "/".join(parts) + "/(?:[^/]+/)*[^/]+$"
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
        .filter(F.col("path").rlike(pattern))
    )
    labels = [F.regexp_extract("path", pattern, i + 1).alias(c) for i, c in enumerate(SCENARIO_COLUMNS)]
    # Files of one write share the middle of their names; other files stand for themselves.
    writer = F.regexp_extract("path", r"/part-\d+-(.{36})[^/]*$", 1)
    named = files.select(*labels, F.when(writer == "", F.col("path")).otherwise(writer).alias("writer"))
    if scales is not None:
        named = named.filter(F.col("scale").isin(list(scales)))
    cases = named.groupBy(*SCENARIO_COLUMNS).agg(F.count_distinct("writer").alias("writes"))
    db_id = F.concat_ws("/", *SCENARIO_COLUMNS)
    one = F.when(F.col("writes") > 1, F.raise_error(F.concat(F.lit("several writes in case "), db_id))).otherwise(db_id)
    return cases.select(*SCENARIO_COLUMNS, one.alias("db_id")).orderBy("db_id")
