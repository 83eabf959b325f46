"""Registered queries of the llm operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelloom.llm import (chunks, decontaminate, langid, merkle, mixing, near_dedup, prefix_trie, quality_classifier, quality_rules, sharding, syncmers, token_counts,
                           toxicity)
from panelloom.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.train(docs, table(spark, sf, "labels"), "toxic", folds=3, fold=1)
    return toxicity.detect(docs, model).select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


@query
def op2_sharding(spark, sf):
    return sharding.byte_shards(table(spark, sf, "documents"), shards=24)


@query
def op3_quality_rules(spark, sf):
    return quality_rules.quality_rules(table(spark, sf, "documents")).drop("failed")


@query
def op4_decontamination(spark, sf):
    found = decontaminate.find_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query
def op5_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    found = langid.identify(docs, langid.dictionaries(docs, folds=3, fold=1))
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op6_substring_dedup(spark, sf):
    return chunks.repeated_spans(table(spark, sf, "documents")).select("doc_id", "first_doc_id", "start", "stop")


@query
def op7_quality_classifier(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality_classifier.train(docs, table(spark, sf, "labels"), "quality", folds=5, fold=0)
    return quality_classifier.classify(docs, model).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


@query
def op8_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), weights=(1, 2, 3)).drop("source")


@query
def op9_near_dedup(spark, sf):
    return near_dedup.near_duplicates(table(spark, sf, "documents"))


@query
def op10_token_counts(spark, sf):
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_document_fingerprints(spark, sf):
    return syncmers.fingerprints(table(spark, sf, "documents"))


@query
def op12_conversation_trie(spark, sf):
    return prefix_trie.prefix_trie(prefix_trie.rebuilt(table(spark, sf, "conversations")))


@query
def op13_merkle_manifest(spark, sf):
    return merkle.manifest(table(spark, sf, "documents"))
