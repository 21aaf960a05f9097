"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    bpe_prefix,
    cosine_cells,
    dart_minhash,
    fill_middle,
    fuzzy_lexicon,
    label_shards,
    phrase_trie,
    rank_profiles,
    source_mix,
    span_privacy,
    token_files,
    vector_packing,
    vp_trees,
)
from .common import part_of, prepare, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f

    return add


@query("op1_token_files")
def op1(spark, d):
    return token_files.token_index(table(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query("op2_source_mix", source_mix.ORACLE)
def op2(spark, d):
    mixed = source_mix.mix_sources(table(spark, d, "documents"), weights=(5, 2, 1), share=1.0, most=3.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op3_cosine_cells")
def op3(spark, d):
    return cosine_cells.near_vectors(table(spark, d, "embeddings"), least=0.95)


@query("op4_rank_profiles")
def op4(spark, d):
    docs = table(spark, d, "documents")
    held_out = part_of("doc_id", 3) == 1
    profiles = rank_profiles.learn_profiles(docs.filter(~held_out).select("text", "lang"))
    found = rank_profiles.predict_language(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op5_label_shards")
def op5(spark, d):
    return label_shards.shard_documents(table(spark, d, "documents"), shards=24)


@query("op6_span_privacy")
def op6(spark, d):
    return span_privacy.find_private(table(spark, d, "documents"))


@query("op7_vp_trees")
def op7(spark, d):
    return vp_trees.nearest(table(spark, d, "embeddings"), every=50, k=5)


@query("op8_fuzzy_lexicon")
def op8(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    held_out = part_of("doc_id", 5) == 0
    model = fuzzy_lexicon.learn(docs.filter(~held_out), table(spark, d, "labels"))
    found = fuzzy_lexicon.predict_toxicity(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op9_dart_minhash")
def op9(spark, d):
    found = dart_minhash.near_duplicates(table(spark, d, "documents"), least=0.8)
    return found.select("doc_id", "class_id", "kept")


@query("op10_vector_packing")
def op10(spark, d):
    return vector_packing.pack_documents(
        table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, most=1024
    )


@query("op11_phrase_trie", phrase_trie.ORACLE)
def op11(spark, d):
    return phrase_trie.collocations(table(spark, d, "documents"), least=10, top=2000)


@query("op12_fill_middle", fill_middle.ORACLE)
def op12(spark, d):
    return fill_middle.middle_digests(table(spark, d, "documents"))


@query("op13_bpe_prefix")
def op13(spark, d):
    return bpe_prefix.round_trip(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
