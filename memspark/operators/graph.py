"""Bounded walks over relationships, map assembly, and topic clusters."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import vectors as V
from memspark.operators import kernels
from memspark.operators.cells import LEFT_BLOCK, RIGHT_BLOCK, match_cells
from memspark.operators.running import top_per_key
from memspark.operators.scope import SCOPE
from memspark.session import cut_lineage, materialize

# Walk and cluster parameters.
MAX_HOPS, MAX_DISCOVERED = 2, 10
MANY_SEEDS = 100
CLUSTER_MIN_SOURCES, CLUSTER_SIMILARITY, CLUSTER_CAP = 9, 0.60, 6
#: Vectors of one place, and pivots of a group of more.
CLUSTER_BLOCK, CLUSTER_PIVOTS = 2048, 32


def graph_walk(edges: DataFrame, seeds: DataFrame, *, max_hops: int = MAX_HOPS, max_results: int = MAX_DISCOVERED, many_seeds: int = MANY_SEEDS) -> DataFrame:
    """Entities reached over current edges in either direction: scope, query_id, id, hop.

    Nearest first, then by id, up to ``max_results`` per query and without the seeds. A hub's
    neighbours cannot all matter: of one node only the smallest ids not yet visited can survive the
    cut, so each adjacency list keeps ``max_results`` and what a query can have visited. Queries of more than
    ``many_seeds`` seeds read whole lists instead, and change nothing for the others.
    """
    live = edges.filter(F.col("valid_until").isNull())
    both = live.select(*SCOPE, F.col("subject_id").alias("node"), F.col("object_id").alias("id")).union(
        live.select(*SCOPE, F.col("object_id"), F.col("subject_id"))
    ).distinct()
    seen = seeds.select(*SCOPE, "query_id", F.col("id")).distinct()
    wide = seen.groupBy(*SCOPE, "query_id").agg((F.count(F.lit(1)) > many_seeds).alias("wide"))
    adjacency = top_per_key(both, [*SCOPE, "node"], [F.col("id")], max_hops * max_results + many_seeds)
    found = None
    frontier = seen
    for hop in range(1, max_hops + 1):
        at = frontier.select(*SCOPE, "query_id", F.col("id").alias("node")).join(wide, [*SCOPE, "query_id"])
        near = at.filter("NOT wide").join(adjacency, [*SCOPE, "node"]).unionByName(at.filter("wide").join(both, [*SCOPE, "node"]))
        fresh = near.select(*SCOPE, "query_id", "id").distinct().join(seen, [*SCOPE, "query_id", "id"], "left_anti")
        fresh = top_per_key(fresh, [*SCOPE, "query_id"], [F.col("id")], max_results).withColumn("hop", F.lit(hop))
        found = fresh if found is None else found.unionByName(fresh)
        seen = seen.unionByName(fresh.drop("hop"))
        frontier = fresh
    return top_per_key(found, [*SCOPE, "query_id"], [F.col("hop"), F.col("id")], max_results)


def memory_map_graph(conversations: DataFrame, relationships: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the map: conversations, the entities they or a relationship name, links.

    ``conversations``: scope, episode_id, ts; ``relationships``: scope, edge_no, subject/object id,
    name and kind; ``mentions``: scope, episode_id, entity_id, entity_name, entity_kind.
    """
    conv = conversations.select(
        *SCOPE, F.concat(F.lit("conversation:"), "episode_id").alias("node_id"), F.lit("conversation").alias("type"),
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("label"),
    )
    named = relationships.select(*SCOPE, F.col("subject_id").alias("e"), F.col("subject_name").alias("n")).union(
        relationships.select(*SCOPE, "object_id", "object_name")
    ).union(mentions.select(*SCOPE, "entity_id", "entity_name"))
    ents = named.groupBy(*SCOPE, "e").agg(F.min("n").alias("label")).select(
        *SCOPE, F.concat(F.lit("entity:"), "e").alias("node_id"), F.lit("entity").alias("type"), "label"
    )
    rel = relationships.select(
        *SCOPE, F.concat(F.lit("relationship:"), F.col("edge_no").cast("string")).alias("edge_id"),
        F.concat(F.lit("entity:"), "subject_id").alias("source"), F.concat(F.lit("entity:"), "object_id").alias("target"),
        F.lit("relationship").alias("type"),
    )
    men = mentions.select(
        *SCOPE, F.concat(F.lit("mentions:"), "episode_id", F.lit(":"), "entity_id").alias("edge_id"),
        F.concat(F.lit("conversation:"), "episode_id").alias("source"), F.concat(F.lit("entity:"), "entity_id").alias("target"),
        F.lit("mentions").alias("type"),
    )
    return conv.unionByName(ents), rel.unionByName(men)


def similarity_cells(rows: DataFrame, keys: list[str], *, sim: float = CLUSTER_SIMILARITY, block: int = CLUSTER_BLOCK) -> tuple[DataFrame, DataFrame]:
    """``rows`` (keys, id, vector) written with ``place``, and the pairs of places (keys, left, right) to look at.

    A group of more than ``block`` vectors is filed under the nearest of some pivots, a pivot's vectors in places of at most
    ``block``. Angles obey the triangle inequality: where the angle between two pivots less the widest angles of
    their vectors is above that of ``sim``, no pair can be alike and the places never meet.
    """
    group = [*keys, "_d"]
    rows = rows.withColumn("_d", F.size("vector"))
    large = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block)
    unit = V.unit(F.col("vector"))
    some = rows.join(large.select(*group), group, "left_semi").filter(F.exists("vector", lambda x: x != 0))
    picked = top_per_key(some.select(*group, F.struct(F.xxhash64("id").alias("h"), "id", unit.alias("v")).alias("_o")), group, [F.col("_o")], CLUSTER_PIVOTS)
    pivots = materialize(picked.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list("_o")), lambda o: o["v"]).alias("_pivots")), "pivots")

    def angle(cosine: Column) -> Column:
        return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))

    filed = rows.join(pivots, group, "left").withColumn("_unit", unit)
    near = F.array_max(F.transform("_pivots", lambda p, i: F.struct(V.dot(p, F.col("_unit")).alias("s"), (-i).alias("i"))))
    filed = filed.withColumn("_near", near).select(*group, "id", "vector", F.coalesce(-F.col("_near.i"), F.lit(0)).alias("_pivot"), F.coalesce(angle(F.col("_near.s")), F.lit(0.0)).alias("_angle"))
    filed = materialize(filed, "filed")
    of_pivot = filed.groupBy(*group, "_pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_parts"), F.max("_angle").alias("_reach"))
    of_pivot = of_pivot.join(pivots, group, "left").withColumn("_at", F.get("_pivots", F.col("_pivot"))).drop("_pivots")
    placed = filed.join(of_pivot.select(*group, "_pivot", "_parts"), [*group, "_pivot"])
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")
    placed = placed.select(*keys, "id", "vector", F.struct("_d", "_pivot", part.alias("_part")).alias("place"))
    # at most some hundred pairs of pivots for each group
    a, b = (of_pivot.withColumnsRenamed({"_pivot": f"_pivot{s}", "_parts": f"_parts{s}", "_reach": f"_reach{s}", "_at": f"_at{s}"}) for s in "ab")
    pairs = a.join(b, group).filter("_pivota <= _pivotb")
    if sim > 0:  # without a direction, or at a threshold below, nothing can be ruled out
        gap = angle(V.dot(F.col("_ata"), F.col("_atb"))) - F.col("_reacha") - F.col("_reachb")
        pairs = pairs.filter((F.col("_pivota") == F.col("_pivotb")) | F.coalesce(gap <= math.acos(min(1.0, sim)) + 1e-5, F.lit(True)))
    parts = pairs.withColumn("_parta", F.explode(F.sequence(F.lit(0), F.col("_partsa") - 1))).withColumn("_partb", F.explode(F.sequence(F.lit(0), F.col("_partsb") - 1)))
    parts = parts.filter("_pivota < _pivotb OR _parta <= _partb")
    ends = [F.struct("_d", F.col(f"_pivot{s}").alias("_pivot"), F.col(f"_part{s}").alias("_part")).alias(name) for s, name in (("a", "left"), ("b", "right"))]
    return placed, parts.select(*keys, *ends)


def similarity_edges(rows: DataFrame, keys: list[str], *, sim: float = CLUSTER_SIMILARITY, block: int = CLUSTER_BLOCK) -> DataFrame:
    """Edges that connect exactly what pairs at or above ``sim`` connect inside each group.

    ``rows``: keys, id, vector. Each pair of places that can hold a pair of alike vectors is one cell, and a cell
    returns a spanning forest instead of its pairs.
    """
    placed, cells = similarity_cells(rows, keys, sim=sim, block=block)
    cell = [*keys, LEFT_BLOCK, RIGHT_BLOCK]
    named = cells.withColumn(LEFT_BLOCK, F.to_json("left")).withColumn(RIGHT_BLOCK, F.to_json("right"))
    sides = [placed.withColumnRenamed("place", side).join(named, [*keys, side]).select(*cell, "id", "vector") for side in ("left", "right")]
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in keys], f"src {types['id']}", f"dst {types['id']}"])
    return match_cells(*sides, cell, kernels.similar_forest(keys, sim, 6), schema).filter("src != dst")


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Label every node (keys, id) with the smallest id of its connected part.

    Each round a node takes the smallest label among itself and its neighbours, then jumps to that
    label's own label, so long chains halve. Labels only meet by equi-join and min, both combined
    before the shuffle; lineage is cut by a reliable checkpoint each round. Labels only fall, so the
    rounds end by themselves when none does.
    """
    both = edges.select(*keys, "src", "dst").union(edges.select(*keys, F.col("dst"), F.col("src"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes.select(*keys, "id", F.col("id").alias("label")))
    changed = True
    while changed:
        near = both.join(labels.select(*keys, F.col("id").alias("dst"), "label"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("id")).agg(
            F.min("label").alias("_near")
        )
        lower = labels.join(near, [*keys, "id"], "left").select(
            *keys, "id", F.col("label").alias("_old"), F.least("label", F.coalesce("_near", "label")).alias("label")
        )
        jump = lower.select(*keys, F.col("id").alias("label"), F.col("label").alias("_via"))
        # old labels learn what their members saw, so whole parts move together
        hooked = lower.groupBy(*keys, F.col("_old").alias("id")).agg(F.min("label").alias("_hook"))
        moved = lower.join(hooked, [*keys, "id"], "left").withColumn("label", F.least("label", F.coalesce("_hook", "label"))).drop("_hook")
        jump = moved.select(*keys, F.col("id").alias("label"), F.col("label").alias("_via"))
        labels = cut_lineage(
            moved.join(jump, [*keys, "label"], "left").select(*keys, "id", "_old", F.least("label", F.coalesce("_via", "label")).alias("label"))
        )
        changed = labels.filter("label != _old").limit(1).count()
        labels = labels.drop("_old")
    return labels


def topic_clusters(sources: DataFrame, *, min_sources: int, sim: float = CLUSTER_SIMILARITY, block: int = CLUSTER_BLOCK) -> DataFrame:
    """Cluster id of every source of busy (scope, day) groups: scope, day, id, cluster.

    ``sources``: scope, day, id, vector. A cluster is named by its smallest source id; days with
    fewer than ``min_sources`` sources stay one cluster.
    """
    keys = [*SCOPE, "day"]
    sizes = sources.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_first"))
    tagged = sources.join(sizes, keys)
    busy = tagged.filter(F.col("_n") >= min_sources).select(*keys, "id", "vector")
    calm = tagged.filter(F.col("_n") < min_sources).select(*keys, "id", F.col("_first").alias("cluster"))
    labels = components(busy.select(*keys, "id"), similarity_edges(busy, keys, sim=sim, block=block), keys)
    return labels.withColumnRenamed("label", "cluster").unionByName(calm)


def cluster_centroids(sources: DataFrame, clusters: DataFrame, dimensions: int) -> DataFrame:
    from memspark.functions.vectors import vector_mean

    keys = [*SCOPE, "day"]
    rows = sources.join(clusters, [*keys, "id"])
    return vector_mean(rows, [*keys, "cluster"], "vector", dimensions).withColumnRenamed("mean", "centroid")


def cluster_cap(sources: DataFrame, clusters: DataFrame, *, dimensions: int, cap: int = CLUSTER_CAP) -> DataFrame:
    """Clusters after merging the two most similar centroids until ``cap`` remain per (scope, day).

    Only centroids travel; groups already within the cap never reach Python.
    """
    keys = [*SCOPE, "day"]
    counts = clusters.groupBy(*keys).agg(F.countDistinct("cluster").alias("_c"))
    over = clusters.join(counts.filter(F.col("_c") > cap).select(*keys), keys, "left_semi")
    cents = cluster_centroids(sources, over, dimensions).withColumn("centroid", F.col("centroid").cast("array<float>"))
    types = dict(clusters.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in keys], f"cluster {types['cluster']}", f"merged {types['cluster']}"])
    merged = cents.groupBy(*keys).applyInPandas(kernels.merge_centroids(cap), schema)
    return clusters.join(merged, [*keys, "cluster"], "left").select(*keys, "id", F.coalesce("merged", "cluster").alias("cluster"))
