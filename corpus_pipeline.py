"""A corpus pipeline over ``documents``: language, near-duplicates, repeated passages, pseudonyms, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the one before it kept. All but the last return
the columns of ``documents``; where a stage changes ``text``, ``n_chars`` follows. Rows with null or empty texts pass the
stages that have nothing to say about them: the first rejects them, for they have no letter.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import common, language_id, near_duplicates, packing, pseudonyms, substring_dedup

def _with_text(docs: DataFrame, made: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``made``, with ``n_chars`` of the new text."""
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter that their best language's tree codes in fewer than eight bits a byte (512 bits apart).

    Noise and languages that no label names cost more, as their symbols and contexts are unknown to every tree.
    """
    model = language_id.fit(docs.filter(~common.held_out("doc_id")))
    aside = {f.name: f"_documents_{f.name}" for f in language_id.FIELDS if f.name in docs.columns}
    found = language_id.identify(docs.withColumnsRenamed(aside), model)
    rate = F.col("bits_per_byte") - language_id.FREE_BITS / F.octet_length("text")
    kept = found.filter((F.col("lang_pred") != language_id.NONE) & (rate < language_id.RAW_BITS))
    return kept.drop(*[f.name for f in language_id.FIELDS]).withColumnsRenamed({b: a for a, b in aside.items()}).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by five word shingles at similarity 0.8."""
    found = near_duplicates.near_duplicates(docs, width=5, percent=80)
    return docs.join(found.filter("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 words that start earlier in the corpus."""
    made = substring_dedup.remove_repeats(docs, window=20)
    return _with_text(docs, made.withColumn("text", F.col("kept_text")))


def pseudonyms_for_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal values replaced within their formats."""
    return _with_text(docs, pseudonyms.pseudonymise(docs, key="documents"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language), ("near_duplicates", near_duplicate), ("substring_dedup", repeated_passages),
    ("pseudonyms", pseudonyms_for_values), ("packing", pack)]

#: SQL cannot express the trained model, the permutations or the tokeniser.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written as Parquet and read again; what a stage has read is then deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = common.scratch(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.drop_scratch(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
