"""Stage outputs written once to the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# For tables that grow with the lines; others are written as the session says.
CODEC = "zstd"

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for stage tables, readable by the driver and all executors.

    It is ``spark.checkpoint.dir``. Only local mode may leave it unset: there all
    tasks run in one process and see a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="quantaint-")
    return _local_roots[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{shared_root(spark)}/quantaint/{app}/{label}-{uuid.uuid4().hex}"


def keep(
    df: DataFrame,
    label: str,
    partition_by: tuple[str, ...] = (),
    bucket_by: tuple[str, ...] = (),
    buckets: int = 0,
    codec: str = "",
) -> DataFrame:
    """Write ``df`` and return the written table; later plans start from its scan.

    Tables dealt into as many buckets by the same keys are joined and grouped by these without a shuffle.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    if bucket_by:
        name = "quantaint_" + path.rsplit("/", 1)[1].replace("-", "_")
        dealt = df.repartition(buckets, *bucket_by).write.option("compression", codec or CODEC)
        # Sorted keys take less space.
        dealt.bucketBy(buckets, *bucket_by).sortBy(*bucket_by).saveAsTable(name, format="parquet", path=path)
        return spark.table(name).select(*df.columns)
    written = df.write.option("compression", codec) if codec else df.write
    written.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
