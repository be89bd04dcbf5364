"""Scope rules: every row belongs to one (scope_kind, scope_owner) and every read names its scopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = ["scope_kind", "scope_owner"]


def _is(scope: tuple[str, str]) -> Column:
    return (F.col("scope_kind") == scope[0]) & (F.col("scope_owner") == scope[1])


def scope_filter(df: DataFrame, acting: tuple[str, str], workspace: tuple[str, str]) -> DataFrame:
    """Rows the acting user may read while in a workspace. Plain equality, so it reaches the scan."""
    return df.filter(_is(acting) | _is(workspace))


def writable(df: DataFrame, workspace: tuple[str, str]) -> DataFrame:
    """Rows that may be written: the workspace's own."""
    return df.filter(_is(workspace))


def scope_filter_batch(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows readable by each session (session_id, acting_kind/owner, workspace_kind/owner)."""
    acting = sessions.select("session_id", F.col("acting_kind").alias("scope_kind"), F.col("acting_owner").alias("scope_owner"))
    work = sessions.select("session_id", F.col("workspace_kind").alias("scope_kind"), F.col("workspace_owner").alias("scope_owner"))
    return df.join(acting.union(work).distinct(), SCOPE, "inner")


def writable_batch(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows each session (session_id, workspace_kind/owner) may write: its workspace's own."""
    work = sessions.select("session_id", F.col("workspace_kind").alias("scope_kind"), F.col("workspace_owner").alias("scope_owner"))
    return df.join(work, SCOPE, "inner")


def scope_list(users: DataFrame, teams: DataFrame) -> DataFrame:
    """All scopes: private per user, shared per team. Inputs carry one ``id`` column."""
    private = users.select(F.lit("private").alias("scope_kind"), F.concat(F.lit("user:"), "id").alias("scope_owner"))
    shared = teams.select(F.lit("shared").alias("scope_kind"), F.concat(F.lit("team:"), "id").alias("scope_owner"))
    return private.unionByName(shared).distinct()


def delete_scopes(df: DataFrame, doomed: DataFrame) -> DataFrame:
    """What is left of a table after removing every row of the given scopes."""
    return df.join(doomed.select(*SCOPE).distinct(), SCOPE, "left_anti")


def import_empty_check(targets: DataFrame, *tables: DataFrame) -> DataFrame:
    """Per target scope, how many rows it already has and whether a plain import is allowed."""
    counts = reduce(DataFrame.unionByName, [t.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n")) for t in tables])
    total = counts.groupBy(*SCOPE).agg(F.sum("n").alias("n_rows"))
    n = F.coalesce(F.col("n_rows"), F.lit(0)).cast("long")
    return targets.select(*SCOPE).join(total, SCOPE, "left").select(*SCOPE, n.alias("n_rows"), (n == 0).alias("is_empty"))
