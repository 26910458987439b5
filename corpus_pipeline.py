"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last keep the columns of documents, whatever these are called. Rows
whose doc_id or text is null, empty texts, repeated rows and empty tables go through every stage; what each
stage makes of them is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from convlake.llm.common import staged, work_dir
from convlake.llm.exact_dedup import deduplicated
from convlake.llm.jaccard import one_of_each
from convlake.llm.mixing import mixed_documents
from convlake.llm.packing import pack_documents
from convlake.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, by models of the labelled ones among them.

    Null and empty texts have no evidence and stay unless most labelled documents are toxic; rows that repeat
    are judged alike. Without labels of both classes all stay.
    """
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts, that of the largest doc_id.

    A null text is an empty one, so one row stays for all of both; a null doc_id is below all others.
    """
    return deduplicated(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of near copies, that of the smallest doc_id; a null doc_id is above all others.

    Texts without words all stay.
    """
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Texts without words are never taken; a null source is a source; of rows with one id the decisions are
    by row.
    """
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences of 2048; rows that repeat are packed as often as they come."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: Learned scores and packing aren't SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"{folder}/{k}_{name}")
    return docs
