"""Hints computed from dated facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.functions.timeex import relative_delta_ago

# The largest gap and the sentence around a pair.
MAX_GAP_DAYS = 2
FOUND = "A separate computation over the retrieved facts found a pair of matching events on consecutive days: "
APART = " day(s) apart). As of now, the later of those two was "
CAUTION = ". Use this only if it directly answers the question — otherwise ignore it."


def closest_date_pair(facts: DataFrame, keys: list[str], *, max_gap: int = MAX_GAP_DAYS) -> DataFrame:
    """Per key, the neighbouring facts with the smallest gap, if at most ``max_gap`` days.

    ``facts``: keys, fact_id, description, date. A hot key is split by date: only gaps of up to
    ``max_gap`` days matter, so every fact meets the next one of its own day and the first ones of
    the next ``max_gap`` days, never the key's whole list.
    """
    rows = facts.filter(F.col("date").isNotNull() & (F.trim("description") != ""))
    # neighbours on one day: only the two smallest ids of the key's first such day can win
    same = W.partitionBy(*keys, "date").orderBy("fact_id")
    firsts = rows.withColumn("_n", F.row_number().over(same)).filter("_n <= 2")
    a = firsts.filter("_n = 1").select(*keys, F.col("date").alias("first_date"), F.col("fact_id").alias("first_id"), F.col("description").alias("first"))
    b = firsts.filter("_n = 2").select(*keys, F.col("date").alias("first_date"), F.col("fact_id").alias("second_id"), F.col("description").alias("second"), F.lit(0).alias("gap_days"))
    zero = a.join(b, [*keys, "first_date"]).withColumn("second_date", F.col("first_date"))
    # neighbours on different days: the last fact of a day and the first of the next day with any
    last = rows.groupBy(*keys, "date").agg(F.max("fact_id").alias("first_id"), F.max_by("description", "fact_id").alias("first"))
    near = last.select(*keys, F.col("date").alias("first_date"), "first_id", "first", F.explode(F.sequence(F.lit(1), F.lit(max_gap))).alias("gap_days"))
    near = near.withColumn("second_date", F.date_add("first_date", F.col("gap_days")))
    first = a.select(*keys, F.col("first_date").alias("second_date"), F.col("first_id").alias("second_id"), F.col("first").alias("second"))
    apart = near.join(first, [*keys, "second_date"])
    cols = [*keys, "first_id", "first", "first_date", "second_id", "second", "second_date", "gap_days"]
    pairs = zero.select(*cols).unionByName(apart.select(*cols))
    best = W.partitionBy(*keys).orderBy("gap_days", "first_date", "first_id", "second_date")
    return pairs.withColumn("_best", F.row_number().over(best)).filter("_best = 1").drop("_best")


def aggregation_hint(facts: DataFrame, keys: list[str], as_of: Column, *, questions: DataFrame | None = None, max_gap: int = MAX_GAP_DAYS) -> DataFrame:
    """The sentence told to the model about the closest pair; none when the later date lies ahead.

    With ``questions`` (keys, question) only those that ask for consecutive events get one.
    """
    if questions is not None:
        asked = questions.filter(X.consecutive_intent(F.col("question"))).select(*keys).distinct()
        facts = facts.join(asked, keys, "left_semi")
    pairs = closest_date_pair(facts, keys, max_gap=max_gap)
    ago = relative_delta_ago(F.col("second_date").cast("timestamp_ntz"), as_of)

    def quoted(c: str) -> Column:
        escaped = F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('"'), F.replace(escaped, F.lit("\n"), F.lit("\\n")), F.lit('"'))

    hint = F.concat(
        F.lit(FOUND),
        quoted("first"), F.lit(" on "), F.col("first_date").cast("string"), F.lit(" and "), quoted("second"), F.lit(" on "),
        F.col("second_date").cast("string"), F.lit(" ("), F.col("gap_days").cast("string"),
        F.lit(APART), ago, F.lit(CAUTION),
    )
    return pairs.withColumn("_ago", ago).filter(F.col("_ago") != "").withColumn("hint", hint).drop("_ago")
