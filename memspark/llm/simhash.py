"""SimHash near-duplicates through BK-trees.

A fingerprint bit is the majority over the hashes of a text's word shingles. Distinct fingerprints that
differ in at most two bits agree in two of four 16-bit blocks, so each is filed under its six pairs of
blocks; a pair of blocks is a shard. Every shard has a BK-tree, whose children are keyed by their Hamming
distance to the parent, and a search follows only edges within the radius. The trees of all shards grow
with the corpus, so none is broadcast to everyone: a shard's tree is built where its fingerprints meet, and
a shard of more than ``TREE_SIZE`` becomes several trees, each searched by every part of the shard in a
task of its own. A cell returns a spanning forest of what it found, never all pairs.

Edge cases: a null or empty text or one of white space has fingerprint 0 and is linked like any other;
a null id takes part, but only ids that are not null name a component (null if it has none); repeated rows
appear each; an empty table gives no rows. Columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.tables import table
from memspark.llm.wordchunks import forget_all
from memspark.operators.graph import components
from memspark.session import materialize

RADIUS = 2
WORDS = 3
SEED = 42
TREE_SIZE = 4096
_BLOCK_BITS = 16
#: Signed numbers of different sign differ in a negative number, whose bits Python does not count.
_ALL_BITS = (1 << 64) - 1
_SLICE = 1 << 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes split at the six ASCII blanks alone
    if not words:
        return 0
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    shingles = map(join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else [join(words)]
    return majority(np.array([hashed(s, SEED) for s in shingles], np.uint64))


def majority(codes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are those set in over half of ``codes``."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(codes), _SLICE):
        part = codes[at : at + _SLICE]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    major = np.packbits(ones * 2 > len(codes), bitorder="little")
    return int(major.view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``fp`` of every row."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py() or "") for t in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], fps], names=[*keep, "fp"])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "fp long"])
    return docs.select(F.col(text_col), *keep).mapInArrow(run, schema)


class BkTree:
    """Fingerprints in nested dictionaries keyed by distance to the parent."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, fp: int) -> None:
        if self.root is None:
            self.root = (fp, {})
            return
        value, children = self.root
        while True:
            d = ((fp ^ value) & _ALL_BITS).bit_count()
            below = children.get(d)
            if below is None:
                children[d] = (fp, {})
                return
            value, children = below

    def within(self, fp: int, radius: int) -> list[int]:
        if self.root is None:
            return []
        found, open_ = [], [self.root]
        while open_:
            value, children = open_.pop()
            d = ((fp ^ value) & _ALL_BITS).bit_count()
            if d <= radius:
                found.append(value)
            for edge in range(d - radius, d + radius + 1):
                below = children.get(edge)
                if below is not None:
                    open_.append(below)
        return found


class Parts:
    """Connected parts of what has been joined."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        parent = self.parent
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def same(self, a: int, b: int) -> bool:
        return self.top(a) == self.top(b)

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.top(a), self.top(b)
        self.parent[a] = b
        return a != b


def cell_forest(tree_side: list[int], query_side: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links inside one part (``query_side`` None) or across two parts of a shard."""
    tree, parts, edges = BkTree(), Parts(), []
    if query_side is not None:
        for fp in tree_side:
            tree.add(fp)
    for fp in tree_side if query_side is None else query_side:
        for other in tree.within(fp, radius):
            if parts.join(fp, other):
                edges.append((fp, other))
        if query_side is None:
            tree.add(fp)
    return edges


def _cells(radius: int):
    """``mapInArrow`` over rows sorted by cell: (shard, left, right, part, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sides = None, {}

        def solve() -> list[tuple[int, int]]:
            if cell is None:
                return []
            _, left, right = cell
            return cell_forest(sides.get(left, []), None if left == right else sides.get(right, []), radius)

        for batch in batches:
            edges = []
            for shard, left, right, part, fp in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (shard, left, right) != cell:
                    edges += solve()
                    cell, sides = (shard, left, right), {}
                sides.setdefault(part, []).append(fp)
            if edges:
                yield _edge_batch(edges)
        if edges := solve():
            yield _edge_batch(edges)

    return run


def _edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    src, dst = zip(*edges)
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])


def link_forest(fps: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Links (src, dst) whose connected parts are those of all links between the distinct ``fp``."""
    if radius > 2:
        raise ValueError("pairs of four blocks find at most two differing bits")
    mask = (1 << _BLOCK_BITS) - 1
    blocks = [F.shiftrightunsigned("fp", _BLOCK_BITS * i).bitwiseAND(F.lit(mask)) for i in range(4)]
    shards = F.array(*[
        F.lit(n << 32).bitwiseOR(F.shiftleft(blocks[i], _BLOCK_BITS)).bitwiseOR(blocks[j]) for n, (i, j) in enumerate(combinations(range(4), 2))
    ])
    filed = fps.select("fp", F.explode(shards).alias("shard"))
    sizes = filed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    placed = filed.join(sizes, "shard").withColumn("parts", F.ceil(F.col("n") / tree_size).cast("int"))
    placed = placed.withColumn("part", F.pmod(F.hash("fp"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cells = placed.select("shard", "part", "fp", other).select(
        "shard", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part", "fp"
    )
    cells = cells.repartition("shard", "left", "right").sortWithinPartitions("shard", "left", "right", "fp")
    return cells.mapInArrow(_cells(radius), "src long, dst long")


def fingerprint_components(rows: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE, more: DataFrame | None = None) -> DataFrame:
    """Every distinct ``fp`` of written ``rows`` (fp, doc_id) with ``component``, a number naming its
    connected part, and ``component_id``, the smallest doc_id in it. ``more``: further links (src, dst)."""
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fps")
    links = link_forest(fps.select("fp"), radius, tree_size)
    edges = materialize((links if more is None else links.unionByName(more)).distinct(), "links")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst"))).distinct()
    labels = components(nodes, edges, []).select(F.col("id").alias("fp"), F.col("label").alias("component"))
    linked = materialize(fps.join(labels, "fp"), "linked")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = linked.join(least, "component").select("fp", "component", "component_id")
    alone = fps.join(labels, "fp", "left_anti").select("fp", F.col("fp").alias("component"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone)


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(fingerprints(docs, ["doc_id"]), "simhash")
    named = rows.join(fingerprint_components(rows), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- near copies with edits -----------------------------------------------------------------------------

#: For texts with a few edits: words of a shingle; a text's smallest shingle hashes: so many are kept, and it is
#: filed under the first few of them; a pair is looked at closer if the kept ones estimate ``EDIT_LIKENESS`` (0.8 less
#: three standard errors) and linked if all shingles give 4/5; the most texts, and about the most shingles, of a part.
EDIT_WORDS, SKETCH, FILED, EDIT_LIKENESS, SHARD_ROWS, PART_SHINGLES = 5, 32, 8, 0.55, 1024, 1 << 19


def shingle_hashes(text: str, words: int) -> np.ndarray:
    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    shingles = map(join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [join(found)]
    return np.array([hashed(s, SEED) for s in shingles], np.uint64)


def edit_signatures(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, ``fp`` and ``sketch``."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_all()
        for batch in batches:
            fps, sketches = [], []
            for t in batch.column(0):
                text = t.as_py() or ""
                fps.append(fingerprint(text))
                sketches.append(np.unique(shingle_hashes(text, EDIT_WORDS))[:SKETCH].view("i8"))
            columns = [pa.array(fps, pa.int64()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*keep, "fp", "sketch"])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "fp long, sketch array<long>"])
    return docs.select(F.col(text_col), *keep).mapInArrow(run, schema)


class SketchTest:
    """Which of ``sets`` the sketches estimate to be alike to a query."""

    def __init__(self, sets: list[np.ndarray], values: int):
        self.size = np.array([len(s) for s in sets])
        self.table = np.full((len(sets), SKETCH), values)
        for row, s in zip(self.table, sets):
            row[: len(s)] = s

    def hits(self, query: np.ndarray, mark: np.ndarray, apart: np.ndarray) -> np.ndarray:
        both = mark[self.table]
        shared = both.sum(axis=1)
        union = np.minimum(SKETCH, self.size + len(query) - shared)
        at = np.flatnonzero(apart & (shared >= EDIT_LIKENESS * union))
        both = both[at]
        rank = np.arange(SKETCH) + np.searchsorted(query, self.table[at]) - (np.cumsum(both, axis=1) - both)
        return at[(both & (rank < SKETCH)).sum(axis=1) >= EDIT_LIKENESS * union[at]]


class WholeTest:
    """Which of ``sets`` have a likeness of 4/5 or more to a query, by all their members."""

    def __init__(self, sets: list[np.ndarray], values: int):
        self.size = np.array([len(s) for s in sets])
        self.flat, self.starts = np.concatenate(sets), np.cumsum(self.size) - self.size

    def hits(self, query: np.ndarray, mark: np.ndarray, apart: np.ndarray) -> np.ndarray:
        shared = np.add.reduceat(mark[self.flat], self.starts, dtype=np.int64)
        return np.flatnonzero(apart & (5 * shared >= 4 * (self.size + len(query) - shared)))


def likeness_forest(left: list[np.ndarray], right: list[np.ndarray] | None, test: type) -> list[tuple[int, int]]:
    """Spanning forest (place, place) of the pairs of sets that pass, inside one part or across two; the places of
    ``right`` follow those of ``left``."""
    if not left or right is not None and not right:
        return []
    sets = [*left, *(right or [])]
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]  # numbered in the order of the hashes
    values = int(ids.max()) + 1
    sets = np.split(ids, np.cumsum([len(s) for s in sets])[:-1])
    searched = test(sets[: len(left)], values)
    mark, label, edges = np.zeros(values + 1, bool), np.arange(len(sets)), []
    for i in range(0 if right is None else len(left), len(sets)):
        apart = label[: len(left)] != label[i]
        if not apart.any():
            continue
        mark[sets[i]] = True
        for j in searched.hits(sets[i], mark, apart).tolist():
            if label[j] != label[i]:  # what is joined already needs no link
                edges.append((i, j))
                label[label == label[j]] = label[i]
        mark[sets[i]] = False
    return edges


def _set_cells(test: type):
    """``mapInArrow`` over rows sorted by cell: (shard, left, right, part, fp, values)."""

    def solve(cell, sides) -> list[tuple[int, int]]:
        if cell is None:
            return []
        _, left, right = cell
        a, b = sides.get(left, []), [] if left == right else sides.get(right, [])
        fps = [fp for fp, _ in [*a, *b]]
        forest = likeness_forest([s for _, s in a], None if left == right else [s for _, s in b], test)
        return [(fps[i], fps[j]) for i, j in forest if fps[i] != fps[j]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sides = None, {}
        for batch in batches:
            edges, lists = [], batch.column(5)
            flat, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_pylist()
            for n, (shard, left, right, part, fp) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(5)))):
                if (shard, left, right) != cell:
                    edges += solve(cell, sides)
                    cell, sides = (shard, left, right), {}
                sides.setdefault(part, []).append((fp, flat[offsets[n] : offsets[n + 1]].copy()))
            if edges:
                yield _edge_batch(edges)
        if edges := solve(cell, sides):
            yield _edge_batch(edges)

    return run


def _in_cells(placed: DataFrame, values: str, test: type) -> DataFrame:
    """Links (src, dst) of all pairs that pass in each shard; ``placed``: shard, parts, key, fp and ``values``.

    Every part of a shard meets every other in a task of its own.
    """
    placed = placed.withColumn("part", F.pmod(F.hash("key"), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    cells = placed.select("shard", "part", "fp", values, other).select(
        "shard", F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"), "part", "fp", values
    )
    # cells cost computing time, not bytes, so they are spread by number and not coalesced by size
    n = 4 * int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(n, "shard", "left", "right").sortWithinPartitions("shard", "left", "right", "fp")
    return cells.mapInArrow(_set_cells(test), "src long, dst long")


def sketch_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two shingle sets, estimated from their smallest hashes (exact for small sets)."""
    smallest = np.union1d(a, b)[:SKETCH]
    return float(np.isin(smallest, np.intersect1d(a, b, assume_unique=True)).mean())


def edit_links(rows: DataFrame) -> DataFrame:
    """Links (src, dst) between ``fp`` of written ``rows`` (fp, sketch) that the sketches estimate to be alike.

    Texts with most shingles in common share most of their smallest shingle hashes, so each is filed under
    its own few. A hash that more than ``SHARD_ROWS`` texts hold is cut into parts, and all pairs of parts
    are searched.
    """
    texts = rows.select("fp", "sketch").distinct().withColumn("key", F.xxhash64("sketch"))
    filed = materialize(texts.select("fp", "key", F.explode(F.slice("sketch", 1, FILED)).alias("shard")), "sketches")
    sizes = filed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.select("shard", F.ceil(F.col("n") / SHARD_ROWS).cast("int").alias("parts"))
    return _in_cells(filed.join(sizes, "shard").join(texts, ["fp", "key"]), "sketch", SketchTest)


def exact_links(texts: DataFrame, rows: DataFrame, near: DataFrame) -> DataFrame:
    """Links (src, dst) of all pairs with a likeness of 4/5 or more in the connected parts of the links ``near``.

    ``texts``: doc_id, key and text; ``rows``: their doc_id, key and fp. Sets of all shingles are made only for texts
    in such a part, one of each key.
    """
    edges = materialize(near.distinct(), "near")
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    labels = components(nodes, edges, []).select(F.col("id").alias("fp"), F.col("label").alias("shard"))
    first = rows.groupBy("key", "fp").agg(F.min("doc_id").alias("_id")).join(labels, "fp").withColumnRenamed("key", "_key")
    chosen = texts.join(first, texts["doc_id"].eqNullSafe(first["_id"]) & (texts["key"] == first["_key"])).select("text", "shard", "fp", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 64):  # the sets outgrow their texts
                part = batch.slice(at, 64)
                sets = [np.unique(shingle_hashes(t.as_py() or "", EDIT_WORDS)).view("i8") for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(sets, pa.list_(pa.int64()))], names=["shard", "fp", "key", "shingles"])

    sets = materialize(chosen.mapInArrow(run, "shard long, fp long, key string, shingles array<long>"), "shingles")
    most = F.greatest(F.ceil(F.count(F.lit(1)) / SHARD_ROWS), F.ceil(F.sum(F.size("shingles")) / PART_SHINGLES))
    sizes = sets.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), most.cast("int").alias("parts")).filter("n > 1").drop("n")
    return _in_cells(sets.join(sizes, "shard"), "shingles", WholeTest)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group stays, unchanged: that of the smallest doc_id (nulls last), of equal ids
    that of the smallest hash of its text, of equal rows any one.

    Groups are linked by fingerprints of three words at two bits, as in ``op8``, and for texts with edits by
    a likeness of 4/5 or more of their five-word shingles (``exact_links``).
    """
    columns = docs.columns
    keyed = docs.select(F.struct(*columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.sha2("text", 256))
    rows = materialize(edit_signatures(keyed, ["doc_id", "key"]), "simhash")
    links = exact_links(keyed.select("doc_id", "key", "text"), rows.select("doc_id", "key", "fp"), edit_links(rows))
    named = rows.select("doc_id", "key", "fp").join(fingerprint_components(rows, more=links).select("fp", "component"), "fp")
    order = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "key")
    stay = named.groupBy("component").agg(F.min(order).alias("first")).select(F.col("first.doc_id").alias("keep_id"), F.col("first.key").alias("keep_key"))
    kept = keyed.join(stay, keyed["doc_id"].eqNullSafe(stay["keep_id"]) & (keyed["key"] == stay["keep_key"]))
    return one_of_each(kept, ["keep_id", "keep_key"]).select("row.*")


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    from pyspark.sql import Window as W

    return rows.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(1)))).filter("_nth = 1").drop("_nth")
