"""Job descriptions from text files or a column."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jobs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``jd_id, text``: one job per text file, undecodable bytes replaced."""
    return (
        spark.read.format("binaryFile")
        .load(paths)
        .select(
            F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("jd_id"),
            F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
        )
    )


def jobs_from_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """``jd_id, text`` from texts at hand."""
    return spark.createDataFrame(list(texts.items()), "jd_id string, text string")
