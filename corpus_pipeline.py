"""A training corpus from the table documents, in five stages.

Each stage works on all that the one before kept; between them the rows are
written as Parquet in the folder that the cluster shares, and read again.  What a
stage wrote for itself is deleted when its rows are written, and those when the
next stage has read them.

Defined results.  Null and empty texts are not toxic, are copies of each other for
near-dedup, hold no personal data, and have no tokens.  Null ids are rows like
others.  Repeated rows are copies, of which one stays; of rows that tie for the
smallest id of a group too.  All but the last stage return the columns they were
given, whatever their names.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import _common as c
from tramline.llm.bpe_codec import encode_documents
from tramline.llm.mixing import mix
from tramline.llm.pii import redact
from tramline.llm.simhash import keep_one
from tramline.llm.toxicity import THRESHOLD, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose score reaches the threshold; every other one stays."""
    labels = c.ready(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, threshold=THRESHOLD, keep=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), that of the smallest id."""
    return keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, n_chars following the text."""
    return redact(docs, size_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's weight has them read; none is lost."""
    return mix(docs, add=False)[0]


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of the ids and of what they decode to."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), values=("ids",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", near_dedup),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL expresses none of these stages; tests/llm compares them with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with c.tables_of_a_step() as keep:
            after = c.written(stage(spark, docs, sf_dir), name)
            keep.append(after)
        c.forget(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
