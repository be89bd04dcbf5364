"""Nearest neighbours by an adaptive dimension scan over inverted lists.

Vectors are turned by one random rotation and filed under the nearest of some centroids; a list is kept as
column blocks, a few rotated dimensions each. A query visits its nearest lists. There, squared distances
grow block by block; after each block a hypothesis test asks whether the full distance can still be below
the best k-th distance so far, and gives up candidates for which that is unlikely. What survives is
measured on the original vectors in double precision.

Centroids and the number of lists to visit are fitted on a bounded sample; every vector is filed. Lists of
more than ``CELL_ROWS`` vectors and crowds of more than ``CELL_QUERIES`` queries are cut into cells, one task's
work each. Recall is measured against brute force in the tests.

Edge cases: null vectors, zero vectors, those with null or non-finite components and rows without id take no
part, nor do vectors of another length than most have; of rows with one id, the smallest vector is the query,
and none of them a candidate of it; other repeated rows are candidates each. With fewer candidates than k all
are returned; an empty table gives no rows. Columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.llm.tables import first_by_hash, table
from memspark.session import materialize

#: Vectors the index is fitted on, by hash order, and the most lists there can be.
SAMPLE, MOST_LISTS = 20_000, 1024
#: Sampled queries that decide how many lists are visited, and the share of true neighbours these must hold.
PROBES_FROM, SAMPLE_RECALL = 256, 0.995
ROUNDS, SEED = 8, 11
BLOCK = 16
#: Width of the test; larger gives up less.
EPSILON = 2.8
CELL_ROWS, CELL_QUERIES, STRIP = 4096, 512, 1024


def valid_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, all of one length."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    good = rows.filter(F.col("vec_id").isNotNull() & x.isNotNull()).filter(finite & F.exists(x, lambda v: v != 0))
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    most = good.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return good.filter(F.size("embedding") == (most["d"] if most else 0))


class Index:
    """Rotation, centroids and the number of lists a query visits."""

    def __init__(self, sample: np.ndarray, lists: int, k: int):
        rng = np.random.default_rng(SEED)
        d = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
        for _ in range(ROUNDS):
            near = self._nearest(sample, centroids)
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, sample)
            counts = np.bincount(near, minlength=len(centroids))
            filled = counts > 0
            centroids[filled] = sums[filled] / counts[filled, None]
        self.centroids = centroids
        self.visits = self._needed(sample, k, rng)

    @staticmethod
    def _squares(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        return (centroids**2).sum(1) - 2 * vectors @ centroids.T

    def _nearest(self, vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        return np.concatenate([self._squares(vectors[i : i + 4096], centroids).argmin(1) for i in range(0, len(vectors), 4096)])

    def lists_of(self, vectors: np.ndarray) -> np.ndarray:
        return self._nearest(vectors, self.centroids)

    def order_of(self, vectors: np.ndarray) -> np.ndarray:
        """All lists of each vector, nearest first."""
        return np.argsort(self._squares(vectors, self.centroids), axis=1, kind="stable")

    def _needed(self, sample: np.ndarray, k: int, rng) -> int:
        """Fewest lists with ``SAMPLE_RECALL`` of the sample's true neighbours in them."""
        asked = rng.choice(len(sample), min(PROBES_FROM, len(sample)), replace=False)
        own = self.lists_of(sample)
        place = np.argsort(self.order_of(sample[asked]), axis=1)  # rank of every list for every query
        squares = (sample**2).sum(1) - 2 * sample[asked] @ sample.T
        squares[np.arange(len(asked)), asked] = np.inf
        best = np.argsort(squares, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        ranks = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
        if not len(ranks):
            return 1
        return int(ranks[min(len(ranks) - 1, int(np.ceil(SAMPLE_RECALL * len(ranks))))]) + 1


def fit_index(vectors: DataFrame, k: int) -> Index | None:
    n = vectors.count()
    if not n:
        return None
    sample = first_by_hash(vectors.select("vec_id", "embedding"), F.col("vec_id").cast("string"), SAMPLE, n).select("embedding").toArrow()
    matrix = _matrix(sample.column("embedding").combine_chunks())
    return Index(matrix, int(np.clip(np.sqrt(n) / 2, 1, MOST_LISTS)), k)


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def file_vectors(vectors: DataFrame, index: Index) -> DataFrame:
    """``list`` of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = pa.array(index.lists_of(_matrix(batch.column(1))).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*batch.columns, near], names=["vec_id", "embedding", "list"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>, list int")


def visits(queries: DataFrame, index: Index, sizes: np.ndarray, least: int) -> DataFrame:
    """One row per query and list to visit: its nearest lists, and more while they hold too few vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                order = index.order_of(_matrix(part.column(1)))
                held = np.cumsum(sizes[order], axis=1)
                short = (held < least).sum(1) + 1
                take = np.minimum(np.maximum(short, index.visits), order.shape[1])
                lists = pa.array([o[:n].astype(np.int32) for o, n in zip(order, take)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=["query_id", "vector", "lists"])

    found = queries.select("query_id", "vector").mapInArrow(run, "query_id long, vector array<double>, lists array<int>")
    return found.select("query_id", "vector", F.explode("lists").alias("list"))


def scan_list(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, rotation: np.ndarray, k: int, epsilon: float = EPSILON):
    """(query_id, vec_id, distance) of the k nearest of each query in one list, as far as the tests let."""
    d = vectors.shape[1]
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    turned, asked = vectors @ rotation, queries @ rotation
    edges = list(range(0, d, BLOCK)) + [d]
    blocks = [np.ascontiguousarray(turned[:, a:b].T) for a, b in zip(edges, edges[1:])]
    allowance = [(1 + epsilon / np.sqrt(b)) ** 2 * b / d for b in edges[1:]]
    out = []
    for query_id, query, turn in zip(query_ids, queries, asked):
        best_ids, best = np.zeros(0, ids.dtype), np.zeros(0)
        # the first strip is small: it only finds a first k-th distance
        strips = [0, *range(min(4 * k, len(ids)), len(ids), STRIP), len(ids)]
        for start, stop in zip(strips, strips[1:]):
            alive = np.flatnonzero(ids[start:stop] != query_id) + start
            if len(best) == k:
                limit, sums = best[-1] ** 2, np.zeros(len(alive))
                for block, allowed, a, b in zip(blocks, allowance, edges, edges[1:]):
                    sums += ((block[:, alive] - turn[a:b, None]) ** 2).sum(0)
                    if b < d:
                        stays = sums <= allowed * limit
                        alive, sums = alive[stays], sums[stays]
                        if not len(alive):
                            break
            if len(alive):
                distances = np.sqrt(((vectors[alive] - query) ** 2).sum(1))
                best_ids, best = np.concatenate([best_ids, ids[alive]]), np.concatenate([best, distances])
                first = np.lexsort((best_ids, best))[:k]
                best_ids, best = best_ids[first], best[first]
        out.append((np.full(len(best), query_id), best_ids, best))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(vectors: DataFrame, queries: DataFrame, index: Index, k: int) -> DataFrame:
    """The k nearest found (query_id, rank, vec_id, score) of ``queries`` (query_id, vector) in written
    ``vectors`` (vec_id, embedding, list)."""
    lists = len(index.centroids)
    sizes = np.zeros(lists, np.int64)
    for r in vectors.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():  # one number per list
        sizes[r["list"]] = r["n"]
    asked = materialize(visits(queries, index, sizes, 4 * k + 64), "visits")
    crowds = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = [(i, -(-int(sizes[i]) // CELL_ROWS), -(-n // CELL_QUERIES)) for i, n in sorted(crowds.items())]
    cut = F.broadcast(vectors.sparkSession.createDataFrame(cuts, "list int, rows int, groups int"))  # at most MOST_LISTS rows

    def cell(key: Column, parts: Column) -> Column:
        return F.pmod(F.xxhash64(key), parts).cast("int")

    def every(parts: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

    # "a|b" keys: row part of the list and group of its queries
    data = vectors.join(cut, "list").withColumn("row_part", cell(F.col("vec_id"), F.col("rows"))).withColumn("group", every("groups"))
    ask = asked.join(cut, "list").filter("rows > 0").withColumn("group", cell(F.col("query_id"), F.col("groups"))).withColumn("row_part", every("rows"))
    keys = ["list", "row_part", "group"]
    rotation = index.rotation

    def scan(rows: pa.Table, asks: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not rows.num_rows or not asks.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        found = scan_list(
            rows.column("vec_id").to_numpy(), _matrix(rows.column("embedding")), asks.column("query_id").to_numpy(), _matrix(asks.column("vector")), rotation, k
        )
        return pa.table([pa.array(c) for c in found], names=names)

    left = data.select(*keys, "vec_id", "embedding").groupBy(*keys)
    found = left.cogroup(ask.select(*keys, "query_id", "vector").groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector among all vectors."""
    k = 10
    vectors = materialize(valid_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    index = fit_index(vectors, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    filed = materialize(file_vectors(vectors, index), "lists")
    queries = vectors.filter(F.col("vec_id") % 100 == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("vector"))
    return nearest(filed, queries, index, k)
