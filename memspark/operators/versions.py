"""Append-only version chains: heads, attributes as slowly changing rows, upserts of entities and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.operators import edges
from memspark.operators.running import top_per_key
from memspark.operators.scope import SCOPE
from memspark.session import cut_lineage


def current_versions(df: DataFrame, ident: str = "id", supersedes: str = "supersedes", keys: list[str] | None = None) -> DataFrame:
    """Rows no other row of their scope supersedes."""
    keys = SCOPE if keys is None else keys
    successors = df.filter(F.col(supersedes).isNotNull()).select(*keys, F.col(supersedes).alias(ident))
    return df.join(successors, [*keys, ident], "left_anti")


def current_period_head(summaries: DataFrame) -> DataFrame:
    """The newest current summary of each (scope, level, period)."""
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return top_per_key(current_versions(summaries), [*SCOPE, "level", "period"], order, 1)


def version_number(ident: Column) -> Column:
    digits = F.regexp_extract(ident, r"v(\d+)$", 1)
    return F.when(digits == "", F.lit(None)).otherwise(digits).cast("int")


def next_version(summaries: DataFrame) -> DataFrame:
    """Version number the next summary of each (scope, level, period) gets."""
    return summaries.groupBy(*SCOPE, "level", "period").agg(
        (F.coalesce(F.max(version_number(F.col("id"))), F.lit(0)) + 1).alias("next_version")
    )


def summary_id(owner: Column, period: Column, level: Column, version: Column) -> Column:
    return F.concat(F.lit("sum_"), owner, F.lit("_"), period, F.lit("_"), level, F.lit("_v"), version.cast("string"))


def version_chain_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``depth``, the number of predecessors of each version found in its own group.

    Each round doubles how far an unresolved row sees along its chain, so a chain of n versions takes
    log2(n) rounds; rows that have reached their root leave the loop. On a chain some row resolves in
    every round, so a round without one means that only cycles are left: their rows get the depth -1.
    """
    ids = df.select(*keys, F.col("id").alias("_up"))
    links = (
        df.select(*keys, "id", F.col("supersedes").alias("_up"))
        .join(ids.withColumn("_known", F.lit(True)), [*keys, "_up"], "left")
        .select(*keys, "id", F.when(F.col("_known"), F.col("_up")).alias("_up"))
        .withColumn("depth", F.when(F.col("_up").isNull(), 0).otherwise(1).cast("long"))
    )
    links = cut_lineage(links)
    done = links.filter(F.col("_up").isNull()).select(*keys, "id", "depth")
    fresh, left = done, links.filter(F.col("_up").isNotNull())
    n_left = left.count()
    while n_left:
        up = left.select(*keys, F.col("id").alias("_up"), F.col("_up").alias("_up2"), F.col("depth").alias("_d2"))
        up = up.unionByName(done.select(*keys, F.col("id").alias("_up"), F.lit(None).cast(up.schema["_up2"].dataType).alias("_up2"), F.col("depth").alias("_d2")))
        step = cut_lineage(
            left.join(up, [*keys, "_up"]).select(*keys, "id", F.col("_up2").alias("_up"), (F.col("depth") + F.col("_d2")).alias("depth"))
        )
        fresh, left = step.filter(F.col("_up").isNull()).select(*keys, "id", "depth"), step.filter(F.col("_up").isNotNull())
        before, n_left = n_left, left.count()
        if n_left == before:
            fresh, n_left = left.select(*keys, "id", F.lit(-1).cast("long").alias("depth")), 0
        done = done.unionByName(fresh)
    return df.join(done, [*keys, "id"], "inner")


def current_attribute_heads(memories: DataFrame, newest: list[str] | None = None) -> DataFrame:
    """Newest row of every attribute, tombstones included.

    Chains written apart may leave several heads for one key; the one with the largest ``newest`` columns
    (default ``created_at`` where there is one, then ``id``) stands for it.
    """
    if newest is None:
        newest = [c for c in ("created_at", "id") if c in memories.columns]
    rows = current_versions(memories).filter(F.col("is_static") & F.col("attribute_key").isNotNull())
    return top_per_key(rows, [*SCOPE, "entity_id", "attribute_key"], [F.col(c).desc() for c in newest], 1)


def current_attributes(memories: DataFrame, newest: list[str] | None = None) -> DataFrame:
    """Attribute map and attribute row ids of every entity; one entry per attribute key."""
    heads = current_attribute_heads(memories, newest).filter("grounded")
    entry = F.struct(F.col("attribute_key").alias("key"), F.col("content").alias("value"))
    row = F.struct("attribute_key", "id", "content")
    return heads.groupBy(*SCOPE, "entity_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("attributes"),
        F.array_sort(F.collect_list(row)).alias("attribute_rows"),
    )


def attribute_scd2(memories: DataFrame, updates: DataFrame, replace: bool = False, newest: list[str] | None = None) -> DataFrame:
    """New memory rows of a batch of entity updates.

    ``updates``: scope, entity_id, attributes map, supersedes_keys array and, where one attribute may be given
    several times, ``arrival``. Each given attribute gets a row superseding its current head; later ones of
    the batch supersede the one before, in arrival order. Stale keys (named ones, or with ``replace``
    every key that is not given) get an ungrounded tombstone.
    """
    key = [*SCOPE, "entity_id", "attribute_key"]
    heads = current_attribute_heads(memories, newest).select(*key, F.col("id").alias("head_id"))
    arrival = F.col("arrival") if "arrival" in updates.columns else F.lit(0)
    given = updates.select(*SCOPE, "entity_id", arrival.alias("_at"), F.explode("attributes").alias("attribute_key", "content"))
    order = W.partitionBy(*key).orderBy("_at", "content")
    given = given.withColumn("_nth", F.row_number().over(order) - 1).join(heads, key, "left")

    def ident(supersedes: Column, grounded: Column, nth: Column, content: Column) -> Column:
        base = F.concat_ws("|", *key, F.coalesce(supersedes, F.lit("")), grounded.cast("string"), nth.cast("string"), content)
        return F.concat(F.lit("mem_"), F.substring(F.sha2(base, 256), 1, 24))

    yes, no = F.lit(True), F.lit(False)
    given = given.withColumn("id", ident(F.col("head_id"), yes, F.col("_nth"), F.col("content")))
    before = F.lag("id").over(W.partitionBy(*key).orderBy("_nth"))
    fresh = given.select(*key, "content", yes.alias("grounded"), F.coalesce(before, F.col("head_id")).alias("supersedes"), "id")
    if replace:
        stale = heads.join(updates.select(*SCOPE, "entity_id").distinct(), [*SCOPE, "entity_id"], "left_semi").join(given.select(*key), key, "left_anti")
    else:
        named = updates.select(*SCOPE, "entity_id", F.explode("supersedes_keys").alias("attribute_key")).distinct()
        stale = heads.join(named, key, "left_semi")
    tombs = stale.select(*key, F.lit("").alias("content"), no.alias("grounded"), F.col("head_id").alias("supersedes"))
    tombs = tombs.withColumn("id", ident(F.col("supersedes"), no, F.lit(0), F.lit("")))
    return fresh.unionByName(tombs).withColumn("is_static", F.lit(True))


def entity_upsert(entities: DataFrame, updates: DataFrame) -> DataFrame:
    """Entities after a batch of touches (scope, kind, name, fallback id, as_of).

    Touches of unknown kinds are dropped; a known entity keeps kind and first_seen. Several touches
    of one entity act in ``as_of`` order, so the last one names it.
    """
    ident = X.entity_id(F.col("kind"), F.col("name"), F.col("id"))
    touched = updates.filter(F.col("kind").isin(X.ENTITY_KINDS)).select(*SCOPE, ident.alias("id"), "kind", "name", "as_of")
    touched = touched.filter(F.col("id") != "").groupBy(*SCOPE, "id").agg(
        F.max_by("name", F.struct("as_of", "name")).alias("_name"), F.min_by("kind", F.struct("as_of", "name")).alias("_kind"),
        F.min("as_of").alias("_first"), F.max("as_of").alias("_last"),
    )
    return entities.join(touched, [*SCOPE, "id"], "full_outer").select(
        *SCOPE, "id", F.coalesce("kind", "_kind").alias("kind"), F.coalesce("_name", "name").alias("name"),
        F.coalesce("first_seen", "_first").alias("first_seen"), F.coalesce("_last", "last_updated").alias("last_updated"),
    )


EDGE = edges.EDGE


def endpoint_semi(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose two ends exist in their own scope."""
    ids = entities.select(*SCOPE, "id")
    return edges.join(ids.withColumnRenamed("id", "subject_id"), [*SCOPE, "subject_id"], "left_semi").join(
        ids.withColumnRenamed("id", "object_id"), [*SCOPE, "object_id"], "left_semi"
    )


def dup_edge_nullsafe(edges: DataFrame, existing: DataFrame) -> DataFrame:
    """New edges that neither repeat a stored edge exactly nor restate it without any date."""
    e, x = edges.alias("e"), existing.alias("x")
    same = (F.col("e.scope_kind") == F.col("x.scope_kind")) & (F.col("e.scope_owner") == F.col("x.scope_owner"))
    for c in ("subject_id", "predicate", "object_id"):
        same = same & (F.col(f"e.{c}") == F.col(f"x.{c}"))
    dates = F.col("e.valid_from").eqNullSafe(F.col("x.valid_from")) & F.col("e.valid_until").eqNullSafe(F.col("x.valid_until"))
    undated = F.col("e.valid_from").isNull() & F.col("e.valid_until").isNull()
    return e.join(x, same & (dates | undated), "left_anti")


def normalise_edges(updates: DataFrame) -> DataFrame:
    """Raw updates (subject/object kind and name, predicate, date strings, arrival) as edge rows."""
    known = F.col("subject_kind").isin(X.ENTITY_KINDS) & F.col("object_kind").isin(X.ENTITY_KINDS)
    rows = updates.filter(known).select(
        *SCOPE, X.entity_id(F.col("subject_kind"), F.col("subject_name"), F.lit("")).alias("subject_id"),
        X.predicate_norm(F.col("subject_kind"), F.col("predicate")).alias("predicate"),
        X.entity_id(F.col("object_kind"), F.col("object_name"), F.lit("")).alias("object_id"),
        X.optional_date(F.col("valid_from")).alias("valid_from"),
        X.optional_date(F.col("valid_until")).alias("valid_until"), "arrival",
    )
    return rows.filter((F.col("predicate") != "") & (F.col("subject_id") != "") & (F.col("object_id") != ""))


def rejected_edges(updates: DataFrame, entities: DataFrame) -> DataFrame:
    """Raw updates that become no edge, each with the first ``reason``: what ``normalise_edges`` and ``endpoint_semi`` leave out."""
    kinds = F.col("subject_kind").isin(X.ENTITY_KINDS) & F.col("object_kind").isin(X.ENTITY_KINDS)
    said = F.lower(X.strip(F.coalesce("predicate", F.lit(""))))
    subject, object_ = (X.entity_id(F.col(f"{side}_kind"), F.col(f"{side}_name"), F.lit("")) for side in ("subject", "object"))
    reason = (
        F.when(~F.coalesce(kinds, F.lit(False)), "unknown kind").when(F.octet_length(said) > X.PREDICATE_MAX_BYTES, "predicate too long").when(said == "", "no predicate")
        .when((F.coalesce(subject, F.lit("")) == "") | (F.coalesce(object_, F.lit("")) == ""), "no identifier")
    )
    rows = updates.withColumns({"_subject": subject, "_object": object_, "reason": reason})
    ids = entities.select(*SCOPE, "id").distinct()
    for side in ("_subject", "_object"):
        rows = rows.join(ids.withColumnRenamed("id", side).withColumn(f"{side}_known", F.lit(True)), [*SCOPE, side], "left")
    unknown = F.col("_subject_known").isNull() | F.col("_object_known").isNull()
    return rows.withColumn("reason", F.coalesce("reason", F.when(unknown, "unknown entity"))).filter("reason is not null").select(*updates.columns, "reason")


def relationship_upsert(existing: DataFrame, updates: DataFrame, entities: DataFrame, bucket_rows: int = edges.BUCKET_ROWS) -> DataFrame:
    """All edges after ``updates`` (normalised edges with ``arrival``) came in, in arrival order.

    A dated edge ends the open edges of the same subject and predicate that point elsewhere and did
    not start later; edges whose ends are not both known are left out (``rejected_edges`` lists them).
    """
    return edges.upsert(existing, endpoint_semi(updates, entities), bucket_rows)


def relationship_upsert_ordered(edges: DataFrame, bucket: Column) -> DataFrame:
    """The same ends for edges that arrive in date order and are never restated.

    Then an edge ends when the next run of another object begins. Runs are found inside (subject,
    predicate, bucket) and linked over the buckets' first and last edges.
    """
    keys = EDGE
    rows = edges.withColumn("_bucket", bucket)
    inside = W.partitionBy(*keys, "_bucket").orderBy("valid_from", "arrival")
    ahead = inside.rowsBetween(1, W.unboundedFollowing)
    rows = rows.withColumn("_starts", F.coalesce(F.lag("object_id").over(inside) != F.col("object_id"), F.lit(False)))
    rows = rows.withColumn(
        "_near", F.first(F.when(F.col("_starts"), F.col("valid_from")), ignorenulls=True).over(ahead)
    )
    heads = edges.withColumn("_bucket", bucket).groupBy(*keys, "_bucket").agg(
        F.min_by("object_id", F.struct("valid_from", "arrival")).alias("_head"), F.min("valid_from").alias("_head_from"),
        F.max_by("object_id", F.struct("valid_from", "arrival")).alias("_last"),
    )
    changes = rows.filter("_starts").groupBy(*keys, "_bucket").agg(F.min("valid_from").alias("_first_change"))
    over = W.partitionBy(*keys).orderBy("_bucket")
    heads = heads.join(changes, [*keys, "_bucket"], "left")
    # the next bucket ends the run if it starts with another object or changes inside; else it is all of
    # the same object, and what ends its own last run ends this one
    other = F.lead("_head").over(over) != F.col("_last")
    stop = F.when(other, F.lead("_head_from").over(over)).otherwise(F.lead("_first_change").over(over))
    far = F.first("_stop", ignorenulls=True).over(over.rowsBetween(0, W.unboundedFollowing))
    heads = heads.withColumn("_stop", stop).select(*keys, "_bucket", far.alias("_far"))
    out = rows.join(heads, [*keys, "_bucket"], "inner")
    return out.withColumn("valid_until", F.coalesce("valid_until", "_near", "_far")).drop("_bucket", "_starts", "_near", "_far")
