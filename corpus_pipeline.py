"""A corpus made ready for training: five stages, each written as Parquet and read again as the next one's input.

Defined results of all stages: null texts count as empty (PII leaves them null); null ids, ids of any size, ties and
repeated rows are allowed; very long texts are read whole; an empty table gives no rows; all stages but the last return the
columns of their input, extra ones as they are, whatever their names (except those that the operators reserve, which begin
with an underscore). The mix is dealt into shards and shuffled within them: as its columns are those of documents, the
deal shows in the order of the written rows alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import mixing, ngram_join, pii, quality_classifier, sentencepiece_codec
from tallyframe.llm.common import documents, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_classifier.train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score_documents(docs, model).where("_predicted = 1").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates in place of personal data."""
    return pii.replace(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy that it takes, dealt into shards and shuffled within them."""
    return mixing.shard_rows(mixing.mix(docs), "_shard").select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    return sentencepiece_codec.encode(docs.select("doc_id", "source", "text")).select(
        "doc_id", "source", F.size("_ids").cast("long").alias("n_pieces"), F.col("_ids").alias("ids")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", private),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

#: No SQL for classifiers, near copies and keyed draws: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for n, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{n}")
    return docs
