"""The queries of this subpackage, over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import bpe, chat, decontaminate, language, oracles, periodic, phrases, pii, quality, secrets, sentencepiece, simhash, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(_table(spark, sf_dir, "pages"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"  # the conversation that the contract adds
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], turns.schema)
    return chat.report(turns.union(more))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece.load_model(spark, sentencepiece.MODEL)
    return sentencepiece.encode_documents(_table(spark, sf_dir, "documents"), model)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(_table(spark, sf_dir, "documents"), bpe.load_ranks(spark, bpe.RANKS))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"))


QUERIES |= {
    f.__name__: f
    for f in (
        op1_secrets,
        op2_warc,
        op3_simhash,
        op4_language_id,
        op5_chat,
        op6_decontamination,
        op7_quality,
        op8_url_filter,
        op9_pii,
        op10_sentencepiece,
        op11_bpe,
        op12_periodic_runs,
        op13_phrases,
    )
}
ORACLE |= {
    "op2_warc": oracles.WARC,
    "op5_chat": oracles.CHAT,
    "op6_decontamination": oracles.DECONTAMINATION,
    "op7_quality": oracles.QUALITY,
    "op8_url_filter": oracles.URLS,
    "op9_pii": oracles.PII,
    "op13_phrases": oracles.PHRASES,
}
