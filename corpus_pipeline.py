"""A training corpus from documents: quality, toxicity, near-duplicates, mixing, tokens."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import bpe, factorization, minhash, mixing
from weftgraph.llm.runtime import read
from weftgraph.plans.lineage import remove_folder, shared_folder


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on those that are labelled, does not reject."""
    classifier = factorization.fit(docs, read(spark, sf_dir, "labels"), "quality", metadata="n_chars")
    return factorization.keep_scored(docs, classifier, lambda score: score >= 0.3, metadata="n_chars")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    classifier = factorization.fit(docs, read(spark, sf_dir, "labels"), "toxic")
    return factorization.keep_scored(docs, classifier, lambda score: score < 0.5)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return minhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.take(mixing.mix(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with the digests of what they are and what they decode to."""
    import public_tokenizers

    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.token_rows(docs, vocabulary, "doc_id", "lang", "source")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("MinHash near-dedup", one_of_each),
    ("mixing sources to target weights", mixed_sources),
    ("byte-level BPE encoding and decoding", token_ids),
]

#: SQL can express neither the classifiers nor the search; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the session's shared folder and read again; what a stage has read goes when the
    next one is written. The last stage reads what the one before it wrote, so that stays."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove_folder(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
