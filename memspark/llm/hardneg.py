"""Hard negatives by rotated one-bit codes with deterministic intervals.

Every row's direction is turned by one random rotation and kept as the signs of its components, with the
alignment of code and direction stored beside it. For an anchor, whose turned direction is cut into a few bit
planes, popcounts estimate its product with a code. What code and direction, or planes and anchor, leave over
is bounded by Cauchy-Schwarz, so each estimate carries an interval that surely holds the true score. Only rows
whose interval reaches the wanted range, or the best scores so far, are scored, in whole numbers. Nothing is
lost: a row outside its interval cannot exist.

Anchors meet all rows in passes: a pass takes a block of anchors of bounded bytes to every task, each task
goes once over its part of the coded rows and returns a few best rows for each anchor, and these are merged.
No row is copied or shuffled for a pass, whatever the size of a label.

Edge cases: rows without id or label, with a null vector or a null or non-finite component take no part; nor do
those with a scaled component of 2**27 or more, whose products could leave 64 bits. Vectors of one length are
searched among their own. Of anchor rows with one id, the smallest (label, vector) is the anchor, and no row of
that id a partner; other repeated rows are partners each. A zero or empty vector scores 0. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.llm.tables import table
from memspark.session import materialize, scratch_path

SEED, PLANES = 13, 4
#: Bytes of the anchors of one pass, as doubles.
BLOCK_BYTES = 4 << 20
#: Scaled components stay below this in size.
LARGEST = 1 << 27
_CODED = "vec_id long, label int, anchor boolean, d int, ints binary, code binary, norm double, align double"
_BEST = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"


def rotation(d: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED + d).standard_normal((d, d)))[0]


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1, bitorder="little")
    room = -packed.shape[-1] % 8
    packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], room), np.uint8)], axis=-1)
    return packed.view("<u8")


def encode(ints: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words, norm and alignment of each row of whole numbers."""
    norm = np.sqrt((ints.astype(np.float64) ** 2).sum(1))
    unit = ints @ turn / np.where(norm > 0, norm, 1)[:, None]
    return _words(unit > 0), norm, np.abs(unit).sum(1) / np.sqrt(max(1, ints.shape[1]))


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` (vec_id, label, anchor, x: array<long>) with their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(4).to_numpy()
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                ints = np.asarray(part.column(3).flatten(), np.int64).reshape(len(part), d)
                if d not in turns:
                    turns[d] = rotation(d)
                code, norm, align = encode(ints, turns[d])
                plain = ints.astype("<i4")
                columns = [
                    *part.columns[:3], part.column(4), pa.array([r.tobytes() for r in plain], pa.binary()), pa.array([r.tobytes() for r in code], pa.binary()),
                    pa.array(norm), pa.array(align),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "anchor", "d", "ints", "code", "norm", "align"])

    return rows.select("vec_id", "label", "anchor", "x", F.size("x").alias("d")).mapInArrow(run, _CODED)


def _table(column, width: int, kind: str) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


class Anchor:
    """One anchor's direction in bit planes, and what bounds its products with codes."""

    def __init__(self, ints: np.ndarray, turn: np.ndarray):
        d = len(ints)
        self.ints, self.d = ints, d
        self.norm = float(np.sqrt((ints.astype(np.float64) ** 2).sum()))
        unit = ints @ turn / (self.norm or 1.0)
        self.low = float(unit.min()) if d else 0.0
        self.step = (float(unit.max()) - self.low) / ((1 << PLANES) - 1) if d else 0.0
        levels = np.rint((unit - self.low) / self.step).astype(np.int64) if self.step else np.zeros(d, np.int64)
        self.total = int(levels.sum())
        self.planes = [_words((levels >> j & 1).astype(bool)) for j in range(PLANES)]
        self.off = float(np.sqrt(((unit - self.low - self.step * levels) ** 2).sum()))
        self.exact = (np.abs(ints).max(initial=0) + 1) * LARGEST * max(d, 1) < 1 << 53

    def interval(self, code: np.ndarray, ones: np.ndarray, norm: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the score of each coded row: popcounts estimate, Cauchy-Schwarz bounds what is left over."""
        held = sum((np.bitwise_count(code & p).sum(1, dtype=np.int64) << j) for j, p in enumerate(self.planes))
        with_code = (self.low * (2 * ones - self.d) + self.step * (2 * held - self.total)) / np.sqrt(max(1, self.d))
        rest = np.sqrt(np.maximum(0.0, 1 - align * align))

        def reach(s: np.ndarray) -> np.ndarray:
            return rest * np.sqrt(np.maximum(0.0, 1 - s * s))

        low, high = np.clip(with_code - self.off, -1, 1), np.clip(with_code + self.off, -1, 1)
        # the upper bound rises with s up to the alignment, the lower one falls down to its opposite
        top, bottom = np.clip(align, low, high), np.clip(-align, low, high)
        most, least = align * top + reach(top), align * bottom - reach(bottom)
        size = norm * self.norm
        slack = 1e-9 * size + 1e-6
        return least * size - slack, most * size + slack

    def scores(self, ints: np.ndarray) -> np.ndarray:
        if self.exact:
            return (ints.astype(np.float64) @ self.ints.astype(np.float64)).astype(np.int64)
        return (ints.astype(np.int64) * self.ints).sum(1)


class Best:
    """The first ``k`` (score descending, id ascending) of what was added."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> float:
        return float(self.scores[-1]) if len(self.scores) == self.k else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        first = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[first], scores[first]


class Part:
    """The coded rows of one Arrow batch."""

    def __init__(self, batch: pa.RecordBatch, d: int):
        self.ids, self.labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        self.ints = _table(batch.column(2), d, "<i4")
        self.code = _table(batch.column(3), -(-d // 64), "<u8")
        self.norm, self.align = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        self.ones = np.bitwise_count(self.code).sum(1, dtype=np.int64)
        order = np.argsort(self.labels, kind="stable")
        names, starts = np.unique(self.labels[order], return_index=True)
        self.of_label = dict(zip(names.tolist(), np.split(order, starts[1:])))

    def same(self, anchor_id: int, label: int) -> np.ndarray:
        at = self.of_label.get(label, np.zeros(0, np.int64))
        return at[self.ids[at] != anchor_id]

    def other(self, anchor_id: int, label: int) -> np.ndarray:
        return np.flatnonzero((self.labels != label) & (self.ids != anchor_id))

    def bounds(self, anchor: Anchor, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return anchor.interval(self.code[at], self.ones[at], self.norm[at], self.align[at])


def first_positives(part: Part, anchor: Anchor, anchor_id: int, label: int, best: Best) -> int:
    """Add the part's rows of the anchor's label that can be among the best; how many were scored."""
    at = part.same(anchor_id, label)
    if not len(at):
        return 0
    least, most = part.bounds(anchor, at)
    floor = best.floor()
    if len(at) > best.k:  # as many surely reach this
        floor = max(floor, np.partition(least, len(at) - best.k)[len(at) - best.k])
    at = at[most >= floor]
    best.add(part.ids[at], anchor.scores(part.ints[at]))
    return len(at)


def first_negatives(part: Part, anchor: Anchor, anchor_id: int, label: int, wanted: dict[int, Best], low: int, high: int) -> int:
    """The same for rows of other labels, for every different positive score in ``wanted``."""
    at = part.other(anchor_id, label)
    if not len(at) or not wanted:
        return 0
    least, most = part.bounds(anchor, at)
    open_ = np.zeros(len(at), bool)
    for score, best in wanted.items():
        open_ |= (100 * most >= max(float(low * score), 100 * best.floor())) & (100 * least <= high * score)
    at = at[open_]
    ids, scores = part.ids[at], anchor.scores(part.ints[at])
    for score, best in wanted.items():
        fits = (low * score <= 100 * scores) & (100 * scores <= high * score)
        best.add(ids[fits], scores[fits])
    return len(at)


def _parts(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[Part]:
    return (Part(b, d) for b in batches if b.num_rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in _BEST.split(", ")])


def _pass(rows: DataFrame, d: int, block: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """All result rows of one block of anchors."""
    ids, labels = block.column("vec_id").to_pylist(), block.column("label").to_pylist()
    ints = _table(block.column("ints"), d, "<i4").astype(np.int64)
    columns = rows.select("vec_id", "label", "ints", "code", "norm", "align")

    def anchors() -> list[tuple[Anchor, int, int]]:
        turn = rotation(d)
        return [(Anchor(x, turn), i, c) for x, i, c in zip(ints, ids, labels)]

    def run_positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = anchors()
        best = [Best(positives) for _ in asked]
        for part in _parts(batches, d):
            for (anchor, i, c), b in zip(asked, best):
                first_positives(part, anchor, i, c, b)
        yield _rows([(i, 0, 0, v, s) for (_, i, _), b in zip(asked, best) for v, s in zip(b.ids.tolist(), b.scores.tolist())])

    def first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    top = first(columns.mapInArrow(run_positives, _BEST), ["anchor_id"], positives)
    chosen = top.select("anchor_id", "vec_id", "score").toArrow()  # a few rows for each anchor of the block
    pairs: dict[int, list[tuple[int, int]]] = {}
    for anchor_id, vec_id, score in zip(*(chosen.column(c).to_pylist() for c in ("anchor_id", "vec_id", "score"))):
        pairs.setdefault(anchor_id, []).append((vec_id, score))

    def run_negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = anchors()
        best = [{s: Best(negatives) for _, s in pairs.get(i, [])} for _, i, _ in asked]
        for part in _parts(batches, d):
            for (anchor, i, c), b in zip(asked, best):
                first_negatives(part, anchor, i, c, b, low, high)
        for (_, i, _), b in zip(asked, best):
            yield _rows([(i, p, s, v, n) for p, s in pairs.get(i, []) for v, n in zip(b[s].ids.tolist(), b[s].scores.tolist())])

    found = first(columns.mapInArrow(run_negatives, _BEST), ["anchor_id", "positive_id", "positive_score"], negatives)
    return found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def mine_hard_negatives(rows: DataFrame, *, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels whose score lies
    between ``low`` and ``high`` hundredths of the positive's.

    ``rows``: vec_id, label, anchor (boolean) and x (array<long>).
    """
    spark = rows.sparkSession
    codes = materialize(coded(rows), "codes")
    picked = codes.filter("anchor").groupBy("d", "vec_id").agg(F.min(F.struct("label", "ints")).alias("m"))
    picked = picked.select("d", "vec_id", "m.label", "m.ints")
    out = scratch_path(spark, "hardneg")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.mode("append").parquet(out)
    sizes = picked.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()  # one row for each vector length
    for d, n in sizes:
        blocks = -(-n * 8 * max(d, 1) // block_bytes)
        placed = materialize(picked.filter(F.col("d") == d).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "anchors")
        for number in range(blocks):
            block = placed.filter(F.col("block") == number).select("vec_id", "label", "ints").toArrow()
            if block.num_rows:
                _pass(codes.filter(F.col("d") == d), d, block, positives, negatives, low, high).write.mode("append").parquet(out)
    return spark.read.schema(schema).parquet(out)


def scaled_rows(rows: DataFrame) -> DataFrame:
    """The rows of an embeddings table that take part, scaled to whole numbers."""
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    scaled = F.transform(x.cast("array<double>"), lambda v: F.floor(F.lit(256.0) * v))
    small = F.forall(x.cast("array<double>"), lambda v: F.abs(F.lit(256.0) * v) < F.lit(float(LARGEST - 1)))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()).filter(finite & small)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), scaled.cast("array<long>").alias("x"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors."""
    rows = scaled_rows(table(spark, sf_dir, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.cast("int").alias("label"), (F.col("vec_id") % 100 == 0).alias("anchor"), "x")
    return mine_hard_negatives(rows)


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
