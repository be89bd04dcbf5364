"""Bounded many-to-many matching inside a key.

Matching every left row with every right row of a scope is what exact search needs, and one scope
may hold a third of all rows. Both sides of a key are therefore cut into blocks of bounded size, a
cell is one left block against one right block, and each cell is one task-sized group handed to a
numpy kernel that returns only its winners, never the pairs it looked at. Small keys have one cell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT_BLOCK, RIGHT_BLOCK = "_lb", "_rb"


def _blocks(df: DataFrame, keys: list[str], size: Column, capacity: int, spread: int, name: str) -> DataFrame:
    """Number of blocks of the keys that need more than one; at most total size x spread / capacity rows."""
    whole = F.ceil(F.col("_size") / capacity)
    return (
        df.groupBy(*keys).agg(F.sum(size).alias("_size"))
        .filter(F.col("_size") * spread > capacity)
        .select(*keys, F.greatest(whole, F.least(F.lit(spread), F.ceil(F.col("_size") * spread / capacity))).cast("int").alias(name))
    )


def cut_into_cells(
    left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], right_id: list[str],
    left_capacity: int, right_capacity: int, left_size: Column | None = None, right_size: Column | None = None,
    left_measure: DataFrame | None = None, right_measure: DataFrame | None = None, left_spread: int = 1, right_spread: int = 1,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with their cell columns, each row repeated once per block of the other side.

    ``left_measure`` and ``right_measure`` are cheaper frames with the same keys to measure sizes on. The counts, a row
    for a key of several blocks, go to all tasks: joined by the key, all rows of a hot scope would meet in one.
    Every block of one side is a copy of the other, so blocks are large; up to ``left_spread`` and ``right_spread`` of them
    may be smaller, down to that part of the capacity, so that a key of middle size is work for several tasks.
    """
    one = F.lit(1)
    lcount = _blocks(left if left_measure is None else left_measure, keys, left_size if left_size is not None else one, left_capacity, left_spread, "_nl")
    rcount = _blocks(right if right_measure is None else right_measure, keys, right_size if right_size is not None else one, right_capacity, right_spread, "_nr")
    counts = F.broadcast(lcount.join(rcount, keys, "full_outer"))

    def place(df, ident, own, other, own_block, other_block):
        own_n, other_n = F.coalesce(F.col(own), F.lit(1)), F.coalesce(F.col(other), F.lit(1))
        return (
            df.join(counts, keys, "left")
            .withColumn(own_block, F.pmod(F.xxhash64(*ident), own_n).cast("int"))
            .withColumn(other_block, F.explode(F.sequence(F.lit(0), (other_n - 1).cast("int"))))
            .drop("_nl", "_nr")
        )

    return (
        place(left, left_id, "_nl", "_nr", LEFT_BLOCK, RIGHT_BLOCK),
        place(right, right_id, "_nr", "_nl", RIGHT_BLOCK, LEFT_BLOCK),
        [*keys, LEFT_BLOCK, RIGHT_BLOCK],
    )


def match_cells(left: DataFrame, right: DataFrame, cell: list[str], kernel: Callable, schema: str) -> DataFrame:
    """Run ``kernel(left_rows, right_rows) -> rows`` once per cell."""
    # fresh column identities: both sides may come from one table
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    # cells cost computing time, not bytes, so they are spread by number and not coalesced by size
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = left.repartition(n, *cell), right.repartition(n, *cell)
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(kernel, schema)
