"""Evaluation aggregates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.plans import evaluate
from memspark.registry import query


@query("accuracy_by_category", "SELECT quality AS category, count(*) AS n, sum(1 - toxic)::BIGINT AS total, round(avg(1 - toxic), 6) AS accuracy FROM labels GROUP BY ROLLUP (quality)")
def accuracy_by_category(t):
    """Labels as scored questions."""
    s = t.labels.select(F.col("quality").alias("category"), (1 - F.col("toxic")).alias("score"))
    return evaluate.accuracy_by_category(s).withColumn("accuracy", F.round("accuracy", 6))


_TEXT = "CASE WHEN conv_id % 5 = 0 THEN text || ' No information available.' WHEN conv_id % 5 = 1 THEN 'It was NOT MENTIONED. ' || text ELSE text END"


@query("abstention_score", f"SELECT conv_id, turn, CASE WHEN contains(lower({_TEXT}), 'no information available') OR contains(lower({_TEXT}), 'not mentioned') THEN 1 ELSE 0 END AS score, coalesce(CASE WHEN turn % 2 = 0 THEN text END, role) AS reference FROM conversations")
def abstention_score(t):
    m = F.col("conv_id") % 5
    text = F.when(m == 0, F.concat("text", F.lit(" No information available."))).when(m == 1, F.concat(F.lit("It was NOT MENTIONED. "), "text")).otherwise(F.col("text"))
    ref = evaluate.reference_answer(F.when(F.col("turn") % 2 == 0, F.col("text")), F.col("role"))
    return t.conversations.select("conv_id", "turn", evaluate.abstention_score(text).alias("score"), ref.alias("reference"))


@query("category_counts_by_key", "SELECT event_type, (props::JSON ->> '$.k')::INTEGER AS memory_key, count(*) AS n FROM events GROUP BY ALL")
def category_counts_by_key(t):
    e = t.events.withColumn("memory_key", F.get_json_object("props", "$.k").cast("int"))
    return evaluate.category_counts_by_key(e, "event_type", "memory_key")


@query("stratified_sample", "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256('42|' || doc_id), doc_id) <= 8")
def stratified_sample(t):
    """Eight documents of every source."""
    return evaluate.stratified_sample(t.documents, "source", "doc_id", n=8, seed=42).select("doc_id", "source")
