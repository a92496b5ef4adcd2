"""From raw documents to packed training sequences: five stages, each written and read again.

1. language: documents without a known language go.
2. near_duplicates: of each group of documents with a five-word shingle similarity of 0.8 or more,
   directly or through others, the smallest id stays.
3. decontaminate: documents that hold a benchmark item, whole or edited, go.
4. personal_data: emails, ip addresses, card and phone numbers are masked.
5. packing: what is left is packed into sequences of at most 2048 tokens.
"""

from pyspark.sql import DataFrame, SparkSession

from matchlane.llm import decontaminate, jaccard, langid, pii
from matchlane.llm.queries import pack_documents
from matchlane.llm.support import small_batches, table
from matchlane.session import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.one_of_each(docs, 5, 80, 100)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.without_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", without_benchmark),
    ("personal_data", personal_data),
    ("packing", packing),
]

# SQL can't express these stages; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
