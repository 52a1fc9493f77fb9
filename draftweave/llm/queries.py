"""Registered queries of this subpackage and their SQL twins.

Each query applies one operator to its whole table and derives the columns of
its contract from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftweave.llm import align, bpe, counts, decontaminate, lm, naming, near, packing, prefixes, quality, records, secrets, urls
from draftweave.llm.sql import SQL
from draftweave.llm.storage import scratch

#: A vocabulary file of the tokenizers library; its ids fit 16 bits.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

#: A sentencepiece file whose pieces the unigram model weighs.
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: A vocabulary file of byte-level merges for the tokenizers library.
BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")

#: Host, path and action of the URL rules.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words and items that each document shares with the benchmark."""
    found = decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near.components(table(spark, folder, "documents"), percent=85).drop("row")


@query
def op3_lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Language-model scores of every document."""
    found = lm.scores(table(spark, folder, "documents"), lm.learning(F.col("doc_id")))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def quality_model(spark: SparkSession, docs: DataFrame, folder: str) -> quality.Model:
    return quality.fit(docs, table(spark, folder, "labels"), ~quality.held_out(F.col("doc_id")))


@query
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.with_score(docs, quality_model(spark, docs, folder))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Words and unigram tokens of every document."""
    return counts.token_counts(table(spark, folder, "documents"), PIECES)


@query
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digest(secrets.spans(table(spark, folder, "documents")))


@query
def op7_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page."""
    return urls.judged(table(spark, folder, "pages"), spark.createDataFrame(RULES, "host string, path string, action string"))


@query
def op8_token_records(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids written to record files and read back."""
    out = scratch(spark)
    records.write(table(spark, folder, "documents"), out, VOCABULARY, end=2)
    return records.in_order(spark, out)


@query
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the copy that stays of its text."""
    return naming.exact_groups(table(spark, folder, "documents"))


@query
def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return packing.pack(table(spark, folder, "documents"), VOCABULARY, end=0)


@query
def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """How two tokenizers cut every document."""
    return align.alignments(table(spark, folder, "documents"), BYTE_LEVEL, PIECES)


@query
def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return prefixes.trie(table(spark, folder, "conversations"))


@query
def op13_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    encoded = bpe.decode(bpe.encode(table(spark, folder, "documents"), VOCABULARY), VOCABULARY)
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


__all__ = ["QUERIES", "SQL"]
