"""A corpus pipeline: quality rules, near-duplicates, repeated passages,
personal data, and packing of what is left to token sequences.

Each stage works on all that its predecessor kept, which is written as Parquet
and read again; what a stage stored on the way is deleted with it. SQL can't
express the learned cutoffs, hashes and tokens, so the whole pipeline is tested
against a brute-force version (`tests/llm/test_pipeline.py`).

Edge cases: a null text fails the quality rules, like an empty one; a null id
counts as larger than any other; of repeated rows, and of near copies, one stays,
that of least id; further columns of any name are kept up to the packing; empty
tables give an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import nearcopies, packing, pii, quality, substrings
from strataloom.llm.common import PREFIX, scratch, shared_dir, table

#: Words of a shingle of the near-duplicate stage.
SHINGLE = 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each group of near copies of Jaccard 0.8 or more."""
    return nearcopies.keep_one(docs, width=SHINGLE)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds; n_chars follows the text."""
    return with_length(substrings.strip(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars follows the text."""
    return with_length(pii.redact(docs, pii.fit(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


def with_length(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType.simpleString()
    return docs.selectExpr(*(f"cast(char_length(text) as {kind}) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", substring_dedup),
    ("personal data", personal_data),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/{PREFIX}pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
    return docs
