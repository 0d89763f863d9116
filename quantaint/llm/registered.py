"""The queries of this subpackage by name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantaint.llm import (
    chat,
    html_text,
    language,
    mixing,
    near_dedup,
    ordinal,
    packing,
    permutation_index,
    quality_rules,
    repair,
    resampling,
    token_files,
    url_rules,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_files.token_offsets(_table(spark, sf_dir, "documents"), tokenizer, end_id=1)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer, end_id=0)


def op2_adaptive_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"))


def op4_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return ordinal.classify_documents(documents, labels)


URL_RULES = [
    url_rules.Rule("org", "/", "allow"),
    url_rules.Rule("example.org", "/es/", "block"),
    url_rules.Rule("example.org", "/en/1", "block"),
    url_rules.Rule("com", "/fr/", "allow"),
    url_rules.Rule("com", "/de/", "block"),
]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), "page_id", URL_RULES)


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings")
    return permutation_index.nearest_neighbours(embeddings, F.col("vec_id") % 100 == 0)


def op7_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digests(turns.unionByName(own))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(_table(spark, sf_dir, "documents"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_conversations(_table(spark, sf_dir, "conversations"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {
        "op1_token_files": op1_token_files,
        "op2_adaptive_quality_rules": op2_adaptive_quality_rules,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_ordinal_quality": op4_ordinal_quality,
        "op5_url_rules": op5_url_rules,
        "op6_permutation_index": op6_permutation_index,
        "op7_cube_mixing": op7_cube_mixing,
        "op8_chat_format": op8_chat_format,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_language": op10_language,
        "op11_html_text": op11_html_text,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_importance_resampling": op13_importance_resampling,
    }
