"""The corpus pipeline: five filters from documents to packed training windows; tokens are byte pairs, as op1 counts them.

Each stage reads what its predecessor kept, written as Parquet. STAGES lists
(name, function); a function takes (spark, docs, sf_dir), returns a DataFrame,
and all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from leaselens.llm import line_dedup, mixing, ngram_join, packing, quality_classifier
from leaselens.llm.common import shared_folder, table

#: The part of all tokens that the mixture may hold; large sources are held back first.
MIX_BUDGET = 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that came before are taken out of the texts."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays; case and the punctuation around words make no difference."""
    return ngram_join.keep_one(docs, fold=True)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut to their quotas of the budget."""
    return mixing.mix(docs, (MIX_BUDGET,))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are packed into windows."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("source mixing", mixture),
    ("packing", windows),
]

#: Learning weights can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again; what a stage has read is removed after it."""
    at = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/{i - 1}")
            done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)
    return docs
