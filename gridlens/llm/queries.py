"""The registered queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridlens.llm import oracles
from gridlens.llm.common import read_table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlens.llm import langid

    docs = read_table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlens.llm.bpe import encode_documents

    return encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlens.llm.chat import format_chats

    return format_chats(read_table(spark, sf_dir, "conversations"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlens.llm.urls import judge_urls

    return judge_urls(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlens.llm.topk import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlens.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlens.llm.pii import find

    return find(read_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlens.llm.substring import dedup

    return dedup(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlens.llm.quality import judge

    return judge(read_table(spark, sf_dir, "documents")).drop("source")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridlens.llm.neardup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"), words=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat_formatting": oracles.OP3, "op5_exact_top_k": oracles.OP5, "op6_mixing": oracles.OP6, "op8_substring_dedup": oracles.OP8, "op9_quality_rules": oracles.OP9, "op10_minhash": oracles.OP10}
