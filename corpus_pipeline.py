"""Corpus pipeline: quality, near-duplicates, decontamination, personal data, packing.

Each stage calls one training-data operator on all documents its predecessor kept.  All stages take null, empty
and very long texts, rows without an id, repeated rows, empty tables and further columns of any type; what each
does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common, decontamination, packing, pii, quality, simhash


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field, fitted on the labelled ones outside the held-out fold, scores 0.3 or more.

    Null and empty texts are scored as one empty line, rows without an id like any other, repeated rows alike (all
    stay or all go); no documents give none; without labels of both kinds every document gets the same prior.
    """
    return quality.keep_good(docs, quality.train(docs, common.read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group linked by fingerprints within two bits.

    Null, empty and blank texts are one group.  Of unlike texts under one id each is judged as its own document; of
    rows that repeat both one stays; a tie of ids goes to the smallest digest of the text.  Rows without an id all stay.
    """
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in benchmark windows, or none.

    Null texts have no words and stay; every row is judged by its own text; an empty benchmark removes nothing.
    """
    return decontamination.remove_documents(docs, common.read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind.

    Null texts stay null, empty ones empty; of overlapping spans the first one's kind is named.
    """
    return pii.redact(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, one row each.

    A null or empty text is its end id alone; rows without an id keep a null one; repeated rows are packed each.
    """
    return packing.pack_documents(docs).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", personal_data),
    ("packing", sequence_packing),
]
#: A fitted field, boosted trees and a tokenizer have no SQL form; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each keeps is written to the shared folder and read again.

    A stage's table is dropped once the next one's is written; the last one stays, for the result reads it.
    """
    docs, before = common.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = common.stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            common.drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
