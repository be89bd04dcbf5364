"""Reading and writing memory tables as parquet with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.schemas import DDL, struct

# Tables with a clock are laid out by day, so date filters prune folders.
DAY_OF = {"episodes": "ts", "audit_log": "ts", "summaries": "created_at"}


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    ddl = DDL[name] + (", day date" if name in DAY_OF else "")
    return spark.read.schema(struct(ddl)).parquet(f"{root.rstrip('/')}/{name}")


def load_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: load_table(spark, root, name) for name in DDL}


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Write rows with the declared columns; missing ones become NULL.

    Clocked tables are split by scope kind and day and sorted by owner inside, so a scope's rows lie
    together and its range shows in the file statistics. The spread is by row, not by scope: one
    scope may hold a third of all rows.
    """
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(DDL[name])]
    rows = df.select(*cols)
    if name in DAY_OF:
        rows = rows.withColumn("day", F.to_date(DAY_OF[name]))
        rows = rows.repartitionByRange("scope_kind", "day", "scope_owner", "id").sortWithinPartitions("scope_kind", "day", "scope_owner")
        rows.write.mode(mode).partitionBy("scope_kind", "day").parquet(f"{root.rstrip('/')}/{name}")
    else:
        rows.repartitionByRange("scope_kind", "scope_owner", "id").sortWithinPartitions("scope_kind", "scope_owner").write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")
