"""The queries opN_<name> and the pipeline, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import _common as c


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(c.documents(spark, sf_dir), texts=False)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.token_counts import token_counts

    return token_counts(c.documents(spark, sf_dir), _vocabulary())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.toxicity import toxicity

    return toxicity(c.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.media import media_columns

    return media_columns(c.documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.quality import quality_rules

    return quality_rules(c.documents(spark, sf_dir))


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.pii import pii_spans

    return pii_spans(c.documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.simhash import simhash_components

    return simhash_components(c.documents(spark, sf_dir))


def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.bpe_codec import encode_documents

    return encode_documents(c.documents(spark, sf_dir), _vocabulary(), values=())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tramline.llm.substring_dedup import substring_dedup

    return substring_dedup(c.documents(spark, sf_dir), texts=False)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed order of all documents: which source they stand for, in which round, and where."""
    from tramline.llm.mixing import mix

    rows, _ = mix(c.documents(spark, sf_dir))
    return rows.select("doc_id", "source", "mix_tokens", "mix_weight", "mix_epoch", "mix_place")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
