"""Positions and running sums that do not need a whole group in one task.

A key may hold a third of all rows, so a plain window over the key would put them in one task.
The rows of a key are cut along the ordering by a ``bucket`` column that ascends with it (a day,
a second): windows run inside (key, bucket), the totals of the buckets are summed up in the same way, and
the two are added. Where a key has too many buckets for a task, the totals are range-partitioned, summed
inside each part, and the totals of the parts of a key are summed up a level higher, until a level is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.session import materialize

#: Totals that one task sums up.
LEVEL_ROWS = 100_000


def totals_before(totals: DataFrame, keys: list[str], bucket: str, names: list[str], descending: bool = False, level_rows: int | None = None) -> DataFrame:
    """Written ``totals`` (keys, bucket, names) with each name replaced by the sum over the earlier buckets of its key."""
    level_rows = LEVEL_ROWS if level_rows is None else level_rows
    step = F.col(bucket).desc() if descending else F.col(bucket).asc()

    def before(over):
        over = over.orderBy(step).rowsBetween(W.unboundedPreceding, -1)
        return [F.coalesce(F.sum(n).over(over), F.lit(0)).alias(n) for n in names]

    rows = totals.count()
    if rows <= level_rows:
        return totals.select(*keys, bucket, *before(W.partitionBy(*keys)))
    parts, part = -(-rows // level_rows), f"{bucket}_part"
    placed = materialize(totals.repartitionByRange(parts, *keys, step).withColumn(part, F.spark_partition_id()), "totals")
    inside = placed.select(*keys, bucket, part, *before(W.partitionBy(*keys, part)))
    # a part ends inside one key, so the keys of several parts are fewer than the parts
    of_part = placed.groupBy(*keys, part).agg(*[F.sum(n).alias(n) for n in names])
    several = of_part.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    upper = materialize(of_part.join(several, keys, "left_semi") if keys else of_part, "totals")
    upper = totals_before(upper, keys, part, names, False, level_rows).withColumnsRenamed({n: f"_up_{n}" for n in names})
    added = [(F.col(n) + F.coalesce(F.col(f"_up_{n}"), F.lit(0))).alias(n) for n in names]
    return inside.join(upper, [*keys, part], "left").select(*keys, bucket, *added)


def running_totals(
    df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column,
    total: str, position: str | None = None, descending: bool = False, level_rows: int | None = None,
) -> DataFrame:
    """Add ``total``, the sum of ``value`` over all earlier rows, and the 1-based ``position``."""
    rows = df.withColumn("_rt_bucket", bucket).withColumn("_rt_value", value)
    inside = W.partitionBy(*keys, "_rt_bucket").orderBy(*order)
    rows = rows.withColumn("_rt_pos", F.row_number().over(inside)).withColumn(
        "_rt_before", F.sum("_rt_value").over(inside.rowsBetween(W.unboundedPreceding, -1))
    )
    sums = df.withColumn("_rt_bucket", bucket).groupBy(*keys, "_rt_bucket").agg(
        F.sum(value).alias("_rt_osum"), F.count(F.lit(1)).alias("_rt_on")
    )
    offsets = totals_before(materialize(sums, "totals"), keys, "_rt_bucket", ["_rt_osum", "_rt_on"], descending, level_rows)
    # rows already lie by (keys, bucket); written totals are small on disk, which says little about their rows
    out = rows.join(offsets.hint("merge"), [*keys, "_rt_bucket"], "inner")
    out = out.withColumn(total, F.coalesce(F.col("_rt_before"), F.lit(0)) + F.col("_rt_osum"))
    if position:
        out = out.withColumn(position, (F.col("_rt_pos") + F.col("_rt_on")).cast("long"))
    return out.drop("_rt_bucket", "_rt_value", "_rt_pos", "_rt_before", "_rt_osum", "_rt_on")


def positions(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str, descending: bool = False) -> DataFrame:
    """1-based position of each row within its key."""
    return running_totals(df, keys, bucket, order, F.lit(1), "_rt_skip", name, descending).drop("_rt_skip")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], limit: int, rank: str | None = None) -> DataFrame:
    """First ``limit`` rows of each key. A literal limit lets Spark cut each group before the shuffle."""
    name = rank or "_rt_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= limit)
    return ranked if rank else ranked.drop(name)
