"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

A stage is a function of (spark, docs, sf_dir) and works on every row that its predecessor kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowweft.llm import dart_minhash, rank_profiles, source_mix, span_privacy, vector_packing
from flowweft.llm.common import prepare, table
from flowweft.runtime import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text bears out the language they name, or tells one; those without a text or without letters go.

    Profiles are learned from the documents that name a language, and so are the least scores at which a language counts
    as told (``rank_profiles.least_scores``). A document whose text tells another language than it names goes. One that names
    none needs that score and names the language found from then on. If no document names a language, none can be told
    by profiles, and all with letters stay.
    """
    prepare(spark)
    profiles = rank_profiles.learn_profiles(docs.select("text", "lang"))
    if not profiles:
        return docs.filter(rank_profiles.has_letters("text"))
    least = rank_profiles.least_scores(docs, profiles)
    return rank_profiles.keep_told(docs, profiles, least)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8)."""
    prepare(spark)
    return dart_minhash.drop_near_duplicates(docs, least=0.8)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, plain or disguised, replaced by tags; n_chars follows the text."""
    prepare(spark)
    masked = span_privacy.mask_private(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources have their target shares of words."""
    prepare(spark)
    return source_mix.draw_mix(docs, weights=(5, 2, 1), share=1.0, most=3.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of at most 1024 tokens."""
    prepare(spark)
    return vector_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, most=1024)


STAGES = [
    ("language", identify_language),
    ("near duplicates", remove_near_duplicates),
    ("private data", mask_private),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

# Languages, signatures and tokens have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: one row per packed piece."""
    docs = table(prepare(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
