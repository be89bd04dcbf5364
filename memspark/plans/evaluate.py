"""Scores of evaluation runs and samples of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import contains_any
from memspark.operators.running import top_per_key

# Wordings of an answer that declines.
ABSTENTIONS = ["no information available", "not mentioned"]


def accuracy_by_category(scores: DataFrame, category: str = "category", score: str = "score") -> DataFrame:
    """Count, summed score and mean per category, and overall under a NULL category."""
    return scores.rollup(category).agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("total"), F.avg(score).alias("accuracy"))


def abstention_score(answer: Column) -> Column:
    """An adversarial question is answered right by declining."""
    return F.when(contains_any(F.lower(answer), ABSTENTIONS), 1).otherwise(0)


def reference_answer(answer: Column, adversarial: Column) -> Column:
    return F.coalesce(answer, adversarial)


def category_counts_by_key(rows: DataFrame, category: str, key: str) -> DataFrame:
    return rows.groupBy(category, key).agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(rows: DataFrame, stratum: str, ident: str, *, n: int, seed: int) -> DataFrame:
    """``n`` rows of every stratum, chosen by a seeded hash of the id."""
    draw = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(ident).cast("string")), 256)
    return top_per_key(rows.withColumn("_draw", draw), [stratum], [F.col("_draw"), F.col(ident)], n).drop("_draw")
