"""Corpus to training sequences: the stages of the document pipeline.

Each stage gets the documents its predecessor kept and returns the columns of ``documents``;
the last one returns the packed pieces. Every stage is written and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantaint.llm import mixing, near_dedup, ordinal, packing, quality_rules
from quantaint.sources.store import keep

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Ids up to this number are broadcast to the documents, more are joined by shuffle.
BROADCAST_IDS = 200_000
# Rows of one list of what the mix takes, and rows whose lists are broadcast at once, a byte each.
BLOCK_ROWS = 4096
ROUND_ROWS = 1 << 26


def _placed(documents: DataFrame) -> tuple[DataFrame, Column]:
    """``documents`` as column ``row`` beside ``doc_id`` and ``text``, and the key of each row.

    ``documents`` is a table of Parquet files: a row is known by its file (a 64-bit hash of its
    name) and its place there, whatever its id.
    """
    place = F.struct(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")
    )
    columns = [F.col(c) for c in ("doc_id", "text", "lang", "source")]
    return documents.select(F.struct("*").alias("row"), *columns, place.alias("_row")), F.col("_row")


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents of ``_placed`` rows whose key is not in ``dropped`` (column doc_id).

    Stages drop far fewer documents than they keep, so the short list of dropped keys is
    what is sent to the scan while its measured length allows that.
    """
    stored = keep(dropped.select(F.col("doc_id").alias("_row")).distinct(), "dropped-rows")
    small = stored.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(stored) if small else stored, "_row", "left_anti").select("row.*")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents whose best grade is unlikely go.

    Each row is judged by its own text, also where rows share an id or have none. Null and empty
    texts are graded like others; equal rows share their fate; an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, key = _placed(docs)
    return _without(rows, ordinal.classify_documents(rows, labels, key).filter(~F.col("kept")))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail the base rules or a fence of their group go.

    Null and empty texts fail, with or without an id; rows are judged one by one, so equal rows
    share their fate; null languages and sources are groups; an empty table gives no rows.
    """
    rows, key = _placed(docs)
    judged = quality_rules.apply_rules(rows.select(key.alias("doc_id"), "lang", "source", "text"))
    return _without(rows, judged.filter(~F.col("kept")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: one row of each group stays, that of least id, then of first place.

    Rows are judged by their texts: rows that share an id but no text are no group, rows without
    an id stay only where no row with an id is in their group. Null texts, and texts without words,
    stay; an empty table gives no rows.
    """
    rows, key = _placed(docs)
    first = F.struct(
        F.isnull("doc_id").alias("unnamed"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), key.alias("row")
    )
    groups = near_dedup.near_duplicates(rows, key=first).filter(~F.col("kept"))
    return _without(rows, groups.select(F.col("doc_id.row").alias("doc_id")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each row occurs as many times as the mix takes it, at most three times.

    Nulls, empty texts, repeated rows and ids are rows like others; a source without words gives
    nothing, an empty table no rows. ``docs`` is a table of Parquet files: a row is known by its
    file and its place there, so texts are neither compared nor shuffled. What the mix takes is a
    byte a row, listed by file and block of rows; files are read beside their own lists, in rounds
    of bounded lists (one round for fewer than ``ROUND_ROWS`` rows).
    """
    place = {"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")}
    narrow = docs.select("doc_id", "source", "text", *[c.alias(n) for n, c in place.items()])
    mixed = mixing.mix_sources(narrow, also=("_file", "_at"))
    block = F.floor(F.col("_at") / BLOCK_ROWS)
    lists = mixed.groupBy("_file", block.alias("_block")).agg(
        F.array_sort(F.collect_list(F.struct("_at", F.col("times").cast("tinyint").alias("times"))))["times"].alias("_times")
    )
    sizes = lists.groupBy("_file").agg(F.sum(F.size("_times")).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    rounds = sizes.select("_file", F.floor(F.coalesce(before, F.lit(0)) / ROUND_ROWS).alias("_round"))
    lists = keep(lists.join(rounds, "_file"), "mix-lists")
    rows = docs.select(F.struct("*").alias("row"), *[c.alias(n) for n, c in place.items()])
    rows = rows.withColumn("_block", block)
    taken = F.get("_times", F.pmod(F.col("_at"), F.lit(BLOCK_ROWS)).cast("int"))
    copies = F.explode(F.array_repeat(F.lit(True), taken.cast("int"))).alias("copy")
    parts = []
    for (number,) in lists.select("_round").distinct().orderBy("_round").collect():
        held = F.broadcast(lists.filter(F.col("_round") == number).drop("_round"))
        parts.append(rows.join(held, ["_file", "_block"]).select("row", copies).select("row.*"))
    if len(parts) > 1:
        parts = [keep(part, "mix-round") for part in parts]
    return reduce(DataFrame.unionAll, parts) if parts else docs.limit(0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: every row's ids and an end id in sequences of at most 2048 tokens.

    A null or empty text is its end id alone; repeated rows and ids are packed one by one; longer
    documents are cut; an empty table gives no pieces.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", classify),
    ("quality rules", filter_quality),
    ("near duplicates", deduplicate),
    ("source mixing", mix),
    ("packing", pack_sequences),
]

# A trained classifier, encoding and packing have no SQL form; tests compare the stages with
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
