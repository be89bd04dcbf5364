"""Joins between memory tables. Scope columns are part of every key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.operators.running import top_per_key
from memspark.operators.scope import SCOPE
from memspark.operators.versions import current_versions

MAX_RELATIONSHIPS = 50


def with_names(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with name and kind of both ends; an edge with an unknown end is dropped."""
    e = entities.select(*SCOPE, "id", "name", "kind")
    for side in ("subject", "object"):
        named = e.select(*SCOPE, F.col("id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"), F.col("kind").alias(f"{side}_kind"))
        edges = edges.join(named, [*SCOPE, f"{side}_id"], "inner")
    return edges


def relationships_named(edges: DataFrame, entities: DataFrame, wanted: DataFrame, *, limit: int = MAX_RELATIONSHIPS) -> DataFrame:
    """Relationships of each wanted entity (scope, entity_id): current ones first, newest first.

    ``edges`` carries ``edge_id`` and ``created_at``. The cut comes before the names are joined.
    """
    cols = [*SCOPE, "edge_id", "subject_id", "predicate", "object_id", "valid_from", "valid_until", "created_at"]
    ends = edges.select(*cols, F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("entity_id"))
    # both ends must exist before the cut, or a dangling edge would take a place
    ids = entities.select(*SCOPE, "id")
    for side in ("subject_id", "object_id"):
        ends = ends.join(ids.withColumnRenamed("id", side), [*SCOPE, side], "left_semi")
    mine = ends.join(wanted.select(*SCOPE, "entity_id").distinct(), [*SCOPE, "entity_id"], "left_semi")
    order = [F.col("valid_until").isNull().desc(), F.col("created_at").desc(), F.col("edge_id")]
    return with_names(top_per_key(mine, [*SCOPE, "entity_id"], order, limit, "rank"), entities)


def relationships_in_range(edges: DataFrame, entities: DataFrame, *, start: Column, end: Column, limit: int | None = None) -> DataFrame:
    """Edges valid at some time of [start, end]; an open end reaches without limit."""
    hit = (F.col("valid_from").isNull() | (F.col("valid_from") <= end)) & (F.col("valid_until").isNull() | (F.col("valid_until") >= start))
    rows = edges.filter(hit)
    if limit is not None:
        rows = top_per_key(rows, SCOPE, [F.col("created_at").desc(), F.col("edge_id").desc()], limit)
    return with_names(rows, entities)


def conversation_mentions(episodes: DataFrame, summaries: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities an episode's current daily summary touches: scope, episode_id, entity_id, name, kind."""
    daily = current_versions(summaries).filter(F.col("level") == "daily")
    by_episode = daily.select(*SCOPE, F.col("id").alias("summary_id"), F.explode("source_episode_ids").alias("episode_id"))
    touched = daily.select(*SCOPE, F.col("id").alias("summary_id"), F.explode("entities_touched").alias("entity_id"))
    seen = by_episode.join(episodes.select(*SCOPE, F.col("id").alias("episode_id")), [*SCOPE, "episode_id"], "left_semi")
    pairs = seen.join(touched, [*SCOPE, "summary_id"], "inner")
    named = entities.select(*SCOPE, F.col("id").alias("entity_id"), F.col("name").alias("entity_name"), F.col("kind").alias("entity_kind"))
    return pairs.join(named, [*SCOPE, "entity_id"], "inner").select(*SCOPE, "episode_id", "entity_id", "entity_name", "entity_kind")


def relations_of(fact_ids: DataFrame, relations: DataFrame) -> DataFrame:
    """Outgoing relations of each fact memory as one ordered array; empty when it has none."""
    ref = F.struct("relation_type", F.col("to_memory_id").alias("id"))
    out = relations.groupBy(*SCOPE, F.col("from_memory_id").alias("memory_id")).agg(F.array_sort(F.collect_list(ref)).alias("relations"))
    none = F.array().cast(out.schema["relations"].dataType)
    return fact_ids.join(out, [*SCOPE, "memory_id"], "left").withColumn("relations", F.coalesce("relations", none))


def trace_resolve(episodes: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Every retrieved reference of every episode with the row it names, looked up in its own scope.

    ``episodes``: scope, id, retrieved_refs. ``tables``: kind -> scope, id, shown (text to show).
    One join per kind on that kind's references; what cannot be resolved keeps a NULL.
    """
    refs = episodes.select(F.col("id").alias("episode_id"), F.posexplode("retrieved_refs").alias("pos", "ref"))
    flat = refs.select("episode_id", "pos", F.col("ref.kind").alias("kind"), F.col("ref.scope.kind").alias("scope_kind"), F.col("ref.scope.owner").alias("scope_owner"), F.col("ref.id").alias("id"))
    named = [df.select(F.lit(kind).alias("kind"), *SCOPE, "id", "shown") for kind, df in tables.items()]
    rows = reduce(DataFrame.unionByName, named)
    return flat.join(rows, ["kind", *SCOPE, "id"], "left").withColumn("resolved", F.col("shown").isNotNull())


def locator_resolve(locators: DataFrame, summary_ids: DataFrame, facts: DataFrame, heads: DataFrame) -> DataFrame:
    """Memory ids of portable locators: (entity, attribute) or (exported summary, fact text).

    ``summary_ids``: scope, exported_id, summary_id. Unresolved ones come back with NULL.
    """
    attr = locators.filter(F.col("entity_id").isNotNull()).join(
        heads.select(*SCOPE, "entity_id", "attribute_key", F.col("id").alias("memory_id")), [*SCOPE, "entity_id", "attribute_key"], "left"
    )
    by_text = facts.groupBy(*SCOPE, "summary_id", "fact").agg(F.max("id").alias("_id"))
    moved = locators.filter(F.col("entity_id").isNull()).join(
        summary_ids.select(*SCOPE, F.col("exported_id").alias("summary_ref"), "summary_id"), [*SCOPE, "summary_ref"], "left"
    )
    fact = moved.join(by_text, [*SCOPE, "summary_id", "fact"], "left").withColumn("memory_id", X.fact_memory_id(F.col("_id")))
    return attr.select(*SCOPE, "locator_id", "memory_id").unionByName(fact.select(*SCOPE, "locator_id", "memory_id"))


def memory_locators(memories: DataFrame) -> DataFrame:
    """The portable form of memory ids: entity and attribute, or summary and fact text."""
    return memories.select(
        *SCOPE, F.col("id").alias("memory_id"), F.when(F.col("is_static"), F.col("entity_id")).alias("entity_id"),
        F.when(F.col("is_static"), F.col("attribute_key")).alias("attribute_key"), F.when(~F.col("is_static"), F.col("summary_id")).alias("summary_ref"),
        F.when(~F.col("is_static"), F.col("content")).alias("fact"),
    )


def feedback_owner_check(feedback: DataFrame, episodes: DataFrame) -> DataFrame:
    """Feedback rows with ``accepted``: they must refer to an episode of their own scope."""
    known = episodes.select(*SCOPE, F.col("id").alias("refers_to")).distinct().withColumn("accepted", F.lit(True))
    return feedback.join(known, [*SCOPE, "refers_to"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)))


def self_model_anchor(sessions: DataFrame, entities: DataFrame, attributes: DataFrame, summaries: DataFrame) -> DataFrame:
    """The standing lines of each session: the acting user's self model and the latest daily period.

    ``sessions``: query_id, acting_kind/owner, scope (the workspace). ``attributes``: scope, entity_id, attributes.
    """
    selves = entities.filter(F.col("kind") == "self_model").groupBy(*SCOPE).agg(F.min("id").alias("self_id"))
    selves = selves.join(attributes.select(*SCOPE, F.col("entity_id").alias("self_id"), "attributes"), [*SCOPE, "self_id"], "left")
    me = selves.select(F.col("scope_kind").alias("acting_kind"), F.col("scope_owner").alias("acting_owner"), "self_id", "attributes")
    latest = current_versions(summaries).filter(F.col("level") == "daily").groupBy(*SCOPE).agg(F.max("period").alias("latest_period"))
    rows = sessions.join(me, ["acting_kind", "acting_owner"], "left").join(latest, SCOPE, "left")
    attrs = F.coalesce(F.to_json("attributes"), F.lit("{}"))
    own = F.when(F.col("self_id").isNotNull(), F.concat(F.lit("self_model: "), attrs, F.lit("\n"))).otherwise("")
    last = F.when(F.col("latest_period").isNotNull(), F.concat(F.lit("(latest daily summary: "), "latest_period", F.lit(")\n"))).otherwise("")
    return rows.withColumn("anchor", F.concat(own, last))


def intersect_entities(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Rows whose two entity arrays have something in common, with ``shared``."""
    return rows.withColumn("shared", F.array_intersect(left, right)).filter(F.size("shared") > 0)
