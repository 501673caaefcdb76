"""The documents' way to training sequences, stage by stage; each reads what the one before has written.

Defined cases: null or empty texts have no language and go at the second stage at the latest;
null ids are kept like any other row; of repeated rows one stays (third stage); empty tables of
documents, labels or benchmark give no rows, no rejection and no leak; columns beside those
of documents go along through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, jaccard, langid, packing, quality
from quire.llm.common import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those that the co-trained classifier accepts."""
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those whose text has a language that the classifier is sure enough of."""
    return langid.keep(docs, langid.fit(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates."""
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Those in which no benchmark item occurs."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of training sequences: a row for each piece of a document."""
    return packing.pack_documents(packing.token_counts(docs))


STAGES = [
    ("quality classifier", good_documents),
    ("language ID", known_language),
    ("n-gram Jaccard join", without_copies),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", sequences),
]

ORACLE_SQL = None  # trained models and approximate matching: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
