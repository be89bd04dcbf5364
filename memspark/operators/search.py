"""Vector search: exact cosine top-k per query within a scope, its pruned form, and unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.functions import vectors as V
from memspark.operators import kernels
from memspark.operators.cells import cut_into_cells, match_cells
from memspark.operators.running import top_per_key
from memspark.operators.scope import SCOPE
from memspark.session import materialize

# Similarity floors and result counts.
SUMMARY_SIMILARITY, EPISODE_SIMILARITY, ENTITY_SIMILARITY, WIDENED_SIMILARITY = 0.40, 0.55, 0.50, 0.25
TOP_K, WIDENED_ENTITIES, WIDENED_SUMMARIES, OVERFETCH = 5, 10, 15, 3
DIGITS = 6
VECTORS_PER_CELL, QUERIES_PER_CELL, SPREAD = 1 << 15, 1 << 14, 8


def usable_model(df: DataFrame, model: str | None) -> DataFrame:
    """Rows with a vector of the current model, or of no recorded model."""
    rows = df.filter(F.col("embedding").isNotNull())
    if model is None:
        return rows
    return rows.filter(F.col("embedding_model").isNull() | (F.col("embedding_model") == model))


def pending_model(df: DataFrame, model: str) -> DataFrame:
    """Rows whose vector is missing or of another model."""
    return df.filter(F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(model))


def equal_vectors(vecs: DataFrame, keys: list[str], group: str, k: int) -> DataFrame:
    """Every different vector of a key once, written: keys, vector, ``_groups``, the ``k`` smallest of its groups.

    A group that is not among them has ``k`` others before it wherever this vector is its best, so no search for ``k``
    groups can return it by this vector.
    """
    rows = vecs.filter(F.size("vector") > 0).select(*keys, group, "vector", F.xxhash64("vector").alias("_h"))
    same = W.partitionBy(*keys, "_h", "vector")
    rows = rows.withColumn("_n", F.dense_rank().over(same.orderBy(group))).filter(F.col("_n") <= k)
    rows = rows.withColumn("_groups", F.array_sort(F.collect_set(group).over(same))).withColumn("_n", F.row_number().over(same.orderBy(group)))
    return materialize(rows.filter("_n = 1").select(*keys, "_h", "vector", "_groups"), "differentvectors")


def vector_topk(
    vecs: DataFrame, queries: DataFrame, *, k: int = TOP_K, threshold: float = -1.0, keys: list[str] = SCOPE,
    group: str = "id", exclude_self: bool = False, query_cols: list[str] | None = None,
) -> DataFrame:
    """Best ``k`` groups per query by their most similar vector: keys, query_id, group, sim, rank.

    ``vecs``: keys, group, vector. ``queries``: keys, query_id, query_vector and optionally own ``k``
    (at most ``k``) and ``threshold``. With ``exclude_self`` the group named ``self_id`` is left out.
    Similarities are compared at six digits, equal ones by group. Equal vectors meet the queries once.
    """
    query_cols = ["query_id"] if query_cols is None else query_cols
    q = queries
    if "k" not in q.columns:
        q = q.withColumn("k", F.lit(k))
    if "threshold" not in q.columns:
        q = q.withColumn("threshold", F.lit(float(threshold)))
    wanted = [*keys, *query_cols, "query_vector", "k", "threshold"] + (["self_id"] if exclude_self else [])
    q = q.select(*wanted)
    once = equal_vectors(vecs, keys, group, k + 1 if exclude_self else k)
    left, right, cell = cut_into_cells(once, q, keys, ["_h"], query_cols, VECTORS_PER_CELL, QUERIES_PER_CELL, left_spread=SPREAD, right_spread=SPREAD)
    types = dict(vecs.dtypes) | {c: t for c, t in q.dtypes if c in query_cols}
    schema = ", ".join([*[f"{c} {types[c]}" for c in (*keys, *query_cols, group)], "sim double"])
    found = match_cells(left, right, cell, kernels.vector_best(keys, query_cols, group, "k", DIGITS, exclude_self), schema)
    # a group spread over several cells is among the winners of the cell that holds its best vector
    found = found.groupBy(*keys, *query_cols, group).agg(F.max("sim").alias("sim"))
    order = [F.col("sim").desc(), F.col(group)]
    ranked = top_per_key(found, [*keys, *query_cols], order, k, "rank").withColumn("rank", F.col("rank") - 1)
    if "k" in queries.columns:
        ranked = ranked.join(queries.select(*keys, *query_cols, "k").distinct(), [*keys, *query_cols], "inner").filter("rank < k").drop("k")
    return ranked


def best_over_paraphrases(vecs: DataFrame, variants: DataFrame, *, k: int, threshold: float, keys: list[str] = SCOPE) -> DataFrame:
    """Candidates of several vectors per query, each by its best similarity; re-ranked per query."""
    hits = vector_topk(vecs, variants, k=k, threshold=threshold, keys=keys, query_cols=["query_id", "variant"])
    best = hits.groupBy(*keys, "query_id", "id").agg(F.max("sim").alias("sim"))
    return rank_by_similarity(best, keys)


def rank_by_similarity(hits: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """0-based rank per query; the rows per query are bounded by the search that found them."""
    order = W.partitionBy(*keys, "query_id").orderBy(F.col("sim").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order) - 1)


def fact_channel(facts: DataFrame, queries: DataFrame, *, k: int, threshold: float = -1.0, keys: list[str] = SCOPE) -> DataFrame:
    """Summaries by their nearest fact. A summary found in any block keeps its global best there."""
    vecs = facts.select(*keys, F.col("summary_id").alias("id"), "vector")
    return vector_topk(vecs, queries, k=k, threshold=threshold, keys=keys)


def vector_topk_pruned(
    vecs: DataFrame, queries: DataFrame, *, k: int = TOP_K, anchors: int = 32, keys: list[str] = SCOPE, exclude_self: bool = False,
) -> DataFrame:
    """The rows of ``vector_topk`` without looking at every vector: keys, query_id, id, sim, rank.

    Vectors are filed under the most similar of a scope's ``anchors`` (vectors picked by hash). A query first
    searches its own anchor's cell; its k-th similarity there is a floor. It then visits only the cells
    whose widest angle can still hold something above the floor, so nothing is missed.
    """
    order = F.struct(F.xxhash64("id"), "id", V.unit(F.col("vector")).alias("v"))
    picked = top_per_key(vecs.select(*keys, order.alias("_o")), keys, [F.col("_o")], anchors)
    points = picked.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("_o")), lambda o: o["v"]).alias("_points"))

    def sims(vector: str) -> Column:
        return F.transform("_points", lambda p: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), V.dot(p, V.unit(F.col(vector))))))

    def nearest(rows: DataFrame, vector: str) -> DataFrame:
        rows = rows.join(points, keys).withColumn("_sims", sims(vector)).drop("_points")
        return rows.withColumn("_top", F.array_max(F.transform("_sims", lambda s, i: F.struct(s.alias("s"), (-i).alias("n"))))).withColumn("cell", -F.col("_top.n"))

    filed = materialize(nearest(vecs.select(*keys, "id", "vector"), "vector").select(*keys, "id", "vector", "cell", F.acos("_top.s").alias("_angle")), "filed")
    reach = filed.groupBy(*keys, "cell").agg(F.max("_angle").alias("_reach"))
    reach = reach.groupBy(*keys).agg(F.collect_list(F.struct("cell", "_reach")).alias("_cells"))
    asked = materialize(nearest(queries, "query_vector").select(*queries.columns, "_sims", "cell"), "asked")
    ckeys = [*keys, "cell"]
    inside = filed.select(*ckeys, "id", "vector")
    first = vector_topk(inside, asked.drop("_sims"), k=k, keys=ckeys, exclude_self=exclude_self)
    first = materialize(first.select(*ckeys, "query_id", "id", "sim", "rank"), "first")
    floor = first.filter(F.col("rank") == k - 1).select(*keys, "query_id", F.col("sim").alias("_floor"))
    rest = asked.withColumnRenamed("cell", "_own").join(reach, keys).join(floor, [*keys, "query_id"], "left").withColumn("_c", F.explode("_cells"))
    gap = F.acos(F.get("_sims", F.col("_c.cell"))) - F.col("_c._reach")
    possible = F.when(gap > 0, F.cos(gap)).otherwise(1.0) >= F.coalesce("_floor", F.lit(-1.0)) - 2e-6
    rest = rest.filter((F.col("_c.cell") != F.col("_own")) & possible).withColumn("cell", F.col("_c.cell")).select(*queries.columns, "cell")
    others = vector_topk(inside, rest, k=k, keys=ckeys, exclude_self=exclude_self).select(*first.columns)
    best = first.unionByName(others).groupBy(*keys, "query_id", "id").agg(F.max("sim").alias("sim"))
    return top_per_key(best, [*keys, "query_id"], [F.col("sim").desc(), F.col("id")], k, "rank").withColumn("rank", F.col("rank") - 1)


def candidate_union(*channels: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """Every candidate found by any channel, once."""
    cols = [*keys, "query_id", "id"]
    return reduce(DataFrame.unionByName, [c.select(*cols) for c in channels]).distinct()


def exclude_found(hits: DataFrame, found: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """Hits of one channel another channel has not found already."""
    cols = [*keys, "query_id", "id"]
    return hits.join(found.select(*cols), cols, "left_anti")
