"""Reading the given tables and drawing bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table, read lazily through Spark, wherever ``sf_dir`` lies."""
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def first_by_hash(df: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """The ``rows`` rows of ``df`` (of ``total``) whose key has the smallest md5: a repeatable sample.

    Rows that cannot be among them are left out first, so no more than a few times ``rows`` meet anywhere,
    however many partitions there are.
    """
    share = min(1.0, (4 * rows + 64) / max(total, 1))
    marked = df.withColumn("_order", F.md5(key))
    if share < 1:
        marked = marked.filter(F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") < share * 2**32)
    return marked.orderBy("_order", *df.columns).limit(rows).drop("_order")
