"""Maintenance jobs: re-embedding, backfill of unified rows, re-encryption, retention."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import crypto as C
from memspark.functions import text as X
from memspark.functions.vectors import embed_texts
from memspark.operators.panels import interactions
from memspark.operators.scope import SCOPE, delete_scopes
from memspark.operators.search import pending_model

EPISODE_EMBED_IMPORTANCE = 0.6


def _counts(parts: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in parts.items()]
    return reduce(DataFrame.unionByName, rows)


def pending_facts(facts: DataFrame, summaries: DataFrame, model: str) -> DataFrame:
    """Grounded facts of current summaries whose vector is missing or of another model."""
    old = summaries.filter(F.col("supersedes").isNotNull()).select(*SCOPE, F.col("supersedes").alias("summary_id"))
    return pending_model(facts.filter("grounded"), model).join(old, [*SCOPE, "summary_id"], "left_anti")


def pending_episodes(episodes: DataFrame, model: str) -> DataFrame:
    return pending_model(interactions(episodes).filter(F.col("importance") >= EPISODE_EMBED_IMPORTANCE), model)


def pending_counts(model: str, *, tables: dict[str, DataFrame], episodes: DataFrame, facts: DataFrame, summaries: DataFrame) -> DataFrame:
    """Rows of every table that wait for a vector of ``model``."""
    parts = {name: pending_model(df, model) for name, df in tables.items()}
    parts["episodes"] = pending_episodes(episodes, model)
    parts["facts"] = pending_facts(facts, summaries, model)
    return _counts(parts)


def reembed(pending: DataFrame, text: Column, embed: Callable[[Column], Column], model: str, keys: list[str]) -> DataFrame:
    """Pending rows (told apart by ``keys``) with the current model's vector of their whole text."""
    return embed_texts(pending, keys, text, embed, "embedding").withColumn("embedding_model", F.lit(model))


def pending_backfill(entities: DataFrame, facts: DataFrame, memories: DataFrame) -> DataFrame:
    """Attribute-bearing entities and facts that have no unified row yet."""
    have = memories.filter("is_static").select(*SCOPE, F.col("entity_id").alias("id"))
    ents = entities.filter(F.col("attributes").isNotNull()).join(have, [*SCOPE, "id"], "left_anti")
    ids = memories.select(F.col("id").alias("mem_id"))
    fcts = facts.withColumn("mem_id", X.fact_memory_id(F.col("id"))).join(ids, "mem_id", "left_anti")
    return _counts({"entities": ents, "facts": fcts})


def backfill_memories(entities: DataFrame, facts: DataFrame, memories: DataFrame) -> DataFrame:
    """Unified rows still missing: one per attribute, a marker for empty maps, one per fact.

    Ids follow from the content, so a second run adds nothing.
    """
    have = memories.filter("is_static").select(*SCOPE, F.col("entity_id").alias("id"))
    todo = entities.filter(F.col("attributes").isNotNull()).join(have, [*SCOPE, "id"], "left_anti")
    entry = todo.select(*SCOPE, "id", F.explode_outer("attributes").alias("attribute_key", "content"))
    key = F.coalesce("attribute_key", F.lit("__empty__"))
    attrs = entry.select(
        X.attribute_memory_id(F.col("scope_kind"), F.col("scope_owner"), F.col("id"), key).alias("mem_id"), *SCOPE,
        F.col("id").alias("entity_id"), F.lit(None).cast("string").alias("summary_id"), "attribute_key",
        F.coalesce("content", F.lit("")).alias("content"), F.lit(True).alias("is_static"), F.col("attribute_key").isNotNull().alias("grounded"),
    )
    mirrored = facts.select(
        X.fact_memory_id(F.col("id")).alias("mem_id"), *SCOPE, F.lit(None).cast("string").alias("entity_id"), "summary_id",
        F.lit(None).cast("string").alias("attribute_key"), F.col("fact").alias("content"), F.lit(False).alias("is_static"), "grounded",
    )
    fresh = attrs.unionByName(mirrored)
    return fresh.join(memories.select(F.col("id").alias("mem_id")), "mem_id", "left_anti").withColumnRenamed("mem_id", "id")


def rekey(df: DataFrame, keys: DataFrame, columns: list[str], to_version: DataFrame) -> DataFrame:
    """Re-encrypt ``columns`` of every scope that is not yet at its target key version.

    ``keys``: scope, key_version, key. ``to_version``: scope, target. Rows at the target stay as
    they are, so the job can be repeated.
    """
    goal = df.join(to_version.select(*SCOPE, "target"), SCOPE, "left")
    done = goal.filter(F.col("target").isNull() | (F.col("key_version") == F.col("target"))).drop("target")
    todo = C.with_key(goal.filter(F.col("key_version") != F.col("target")), keys, "key_version", "_old")
    todo = C.with_key(todo, keys, "target", "_new")
    for c in columns:
        todo = todo.withColumn(c, C.encrypt(C.decrypt(F.col(c), F.col("_old")), F.col("_new")))
    todo = todo.withColumn("key_version", F.col("target")).drop("_old", "_new", "target")
    return done.unionByName(todo.select(*done.columns))


def rekey_progress(tables: dict[str, DataFrame], to_version: DataFrame) -> DataFrame:
    """Per table and scope, rows still under another key version than the target."""
    rows = [
        df.join(to_version, SCOPE).groupBy(*SCOPE).agg(F.count(F.when(F.col("key_version") != F.col("target"), 1)).alias("n_left")).withColumn("tbl", F.lit(name))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def unused_key_versions(keys: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """Key versions no row refers to any more, the newest of each scope kept."""
    used = reduce(DataFrame.unionByName, [t.select(*SCOPE, "key_version") for t in tables]).distinct()
    newest = keys.groupBy(*SCOPE).agg(F.max("key_version").alias("key_version"))
    cols = [*SCOPE, "key_version"]
    return keys.select(*cols).join(used, cols, "left_anti").join(newest, cols, "left_anti")


def retention_sweep(sessions: DataFrame, tables: dict[str, DataFrame], *, as_of: Column, max_age_days: int, keep_days: int):
    """(scopes to delete, kept sessions, kept tables) for sessions that expired or grew too old."""
    old = as_of - F.expr(f"INTERVAL {int(max_age_days)} DAYS")
    doomed = sessions.filter(F.col("scope_owner").isNotNull() & ((F.col("expires_at") < as_of) | (F.col("created_at") < old))).select(*SCOPE).distinct()
    kept = sessions.filter(F.col("created_at") >= as_of - F.expr(f"INTERVAL {int(keep_days)} DAYS"))
    return doomed, kept, {name: delete_scopes(df, doomed) for name, df in tables.items()}
