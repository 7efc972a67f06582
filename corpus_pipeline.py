"""A corpus pipeline of four stages over documents: quality, near-duplicates, mixing, encoding.

Every stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents, whatever else they are named like; an empty table goes through as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import op04_quality, op07_simhash, op08_bpe, op09_mixing
from cadenza.llm.common import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It is trained on labels of all folds but the held-out one.

    Rows are judged one by one: repeated ones stay or go together, a null text is judged as an empty one, a tie with the threshold is accepted, and
    every byte of a very long text counts. Without usable labels all documents stay.
    """
    net = op04_quality.train(*op04_quality.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return op04_quality.keep_good(docs, net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies: 0.8 of five-word shingles, or three bits of fingerprints.

    Null and empty texts are copies of each other. Rows that share a doc_id, or have none, are judged by their own texts; of equal rows one
    stays; a null doc_id stays only where its group has no other. Very long texts are compared whole.
    """
    scratch = Scratch(spark, "dedup")
    return op07_simhash.keep_first(docs, op07_simhash.similar_documents(docs, scratch), scratch)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take, at most once each: 0.9 of the tokens, by domain, language and source.

    Null languages and sources are leaves of their own; a null text has one token; rows that repeat a doc_id are taken or left together, and so are ties.
    A very long text is taken whole or not at all.
    """
    return op09_mixing.mix(docs, Scratch(spark, "mix"), share=0.9, epochs=1).select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's token ids and of what they decode to.

    A row for every row; null and empty texts have no tokens; a very long text goes through in runs of its pieces.
    """
    import public_tokenizers

    found = op08_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return Scratch(spark, "encode").keep(found, "digests", texts=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: SQL can't express a trained classifier, XXH64 fingerprints or byte-level BPE; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is a table in the shared folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
