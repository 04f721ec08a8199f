"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    language,
    lexical,
    mixing,
    order_minhash,
    packing,
    phrases,
    pii,
    quality,
    secret_scan,
    sharding,
    simhash,
    token_counts,
)
from .common import documents


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_edits(documents(spark, sf_dir))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(documents(spark, sf_dir))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir))


def op5_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.assess(documents(spark, sf_dir), labels.where("quality = 1").select("doc_id"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(documents(spark, sf_dir))


def op12_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_test_conversation(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat.read_back(chat.format_conversations(turns)).drop("n_tokens")


_QUERIES = (
    op1_order_minhash,
    op2_personal_data,
    op3_simhash,
    op4_token_counts,
    op5_quality_ratio,
    op6_language,
    op7_sharding,
    op8_secret_ownership,
    op9_packing,
    op10_mixing,
    op11_phrases,
    op12_dual_tree_search,
    op13_chat_masks,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracles() -> dict[str, str]:
    return {"op11_phrases": phrases.SQL, "op12_dual_tree_search": lexical.SQL, "op13_chat_masks": chat.SQL}
