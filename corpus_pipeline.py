"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all but the last return
the columns of documents. A stage's result is written to the session's shared folder and read again, so a lost
executor costs no more than the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm import packing, quality, secrets, simhash
from memspark.llm.tables import table
from memspark.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every document stays."""
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as pieces of 4096-token sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


STAGES = [("quality_classifier", quality_stage), ("simhash_near_dedup", near_duplicate_stage), ("secret_scan", secret_stage), ("packing", packing_stage)]

#: A learned classifier, a forest and a tokenizer are beyond SQL. The tests compare the rows that the near-duplicate stage
#: keeps with brute force; of the other stages they test the effect on given tables and small fixtures.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
