"""From raw documents to packed training sequences: five stages over the whole table.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. Every stage
works on all rows that its predecessor kept, defines nulls, empty and repeated rows as its operator does,
and passes empty tables on. Texts that are null, have no letter or are of no learned language go at the first stage; of texts that are
equal or linked as near copies the row with the smallest id stays; extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import _common, exact_dedup, language, near_dedup, packing, quality

#: A language told with less than this is no language told; an even guess among four would be 0.25.
LEAST_LANGUAGE_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.train(language.training_sample(docs)), LEAST_LANGUAGE_SCORE)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.train(quality.training_sample(docs, labels)), quality.LEAST_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_representatives(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: Classifiers are trained, which SQL can't express; tests/llm/test_pipeline.py holds each stage and run() to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's rows written and read again."""
    docs = _common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = _common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
