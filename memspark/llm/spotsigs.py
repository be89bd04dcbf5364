"""SpotSigs document fingerprints.

Common words of four languages are anchors; each anchor and the chain of content words after it is one
spot signature, and a document is the set of them. Boilerplate and reordered parts hardly change the set.
Sets are compared by Jaccard likeness, pruned first by their lengths: if the shorter has less than the
wanted share of the longer, no comparison can reach it. The corpus search puts sets into partitions of
neighbouring lengths, lets only their rarest signatures meet, and compares those that do.

Edge cases: a null text is empty; a text without any chain gets one signature of its words as a whole, so
equal texts always have equal fingerprints and likeness 1. Repeated rows each count as a document; rows of
equal id are ordered by text; null ids come first. An empty table gives no rows, a single document is
its own next one. Columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.tables import table
from memspark.llm.wordchunks import Memory, chunks_of
from memspark.session import materialize

# fixed values: frequent function words of English, German, French and Spanish
ANCHORS = frozenset(
    "a an and are as at be by for from has he in is it of on or that the this to was were will with "
    "auf das dem den der des die ein eine einer für im ist mit nicht sich und von zu "
    "au aux avec ce dans de du en et la le les ne par pas pour que qui sur un une "
    "al como con del el es esta las lo los no para por se su una y".split()
)
#: Content words in a chain, and how many content words apart they stand.
CHAIN, DISTANCE = 2, 1
#: Most ranges of ids; beyond some 100 TB a range grows past its usual few MB and spills when sorted.
MOST_RANGES = 1 << 16
_STRIP = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "¡¿«»“”„…–—"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _code(chunk: str) -> int:
    """Hash of a word; the lowest bit says anchor; 0 for a chunk without letters or digits."""
    word = chunk.lower().strip(_STRIP)
    return (xxhash.xxh64_intdigest(word) & ~1 | (word in ANCHORS)) if word else 0


_CODES = Memory(_code)


def spot_set(text: str, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """Sorted distinct signatures of a whole text."""
    codes = np.array([_CODES[c] for c in chunks_of(text)], np.uint64)
    codes = codes[codes != 0]
    is_anchor = codes & np.uint64(1) == 1
    content = codes[~is_anchor]
    follows = np.cumsum(~is_anchor)[is_anchor]  # the first content word after each anchor
    fits = follows + (chain - 1) * distance < len(content)
    if not fits.any():
        return np.array([xxhash.xxh64_intdigest(codes.tobytes() if len(codes) else text.strip().encode())], np.uint64)
    follows, signature = follows[fits], codes[is_anchor][fits]
    for step in range(chain):
        signature = (signature ^ (signature >> np.uint64(29))) * _MIX + content[follows + step * distance]
    return np.unique(signature ^ (signature >> np.uint64(32)))


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard likeness of two sorted sets; 0 as soon as their lengths rule ``at_least`` out."""
    short, long = sorted((len(a), len(b)))
    if short < at_least * long:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint(spots: np.ndarray) -> str:
    """The set as text of one size: its length and a 128-bit hash of its signatures."""
    return f"{len(spots):08x}-{xxhash.xxh3_128_hexdigest(spots.tobytes())}"


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by the start of ``following``."""
    n = len(text)
    half = n // 2
    return text[: n - half] + following[:half]


# --- neighbours in id order -------------------------------------------------------------------------

_LOWEST = -(1 << 63)


def with_following(docs: DataFrame, parts: int, partitions: int) -> DataFrame:
    """Rows (doc_id, text, part, ahead) dealt by id range and sorted, so that a row's successor follows it.

    The first document of the next range comes along at the end of each range (``ahead``), that of the
    first range at the end of the last. The texts shuffle once. Ranges are finer than ``partitions``, so
    several meet in each and even it out. Driver and tasks see only the range bounds and each range's
    first id: two numbers per range.
    """
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("_key"))
    probabilities = [i / parts for i in range(1, parts)]
    bounds = np.unique(np.array(keyed.approxQuantile("_key", probabilities, 0.2 / parts), "i8")) if parts > 1 else np.array([], "i8")
    own = F.pandas_udf(lambda key: pd.Series(np.searchsorted(bounds, key.to_numpy(), "right")), "long")
    firsts = keyed.select("_key", own("_key").alias("part")).groupBy("part").agg(F.min("_key").alias("first")).orderBy("part").collect()
    starts = {r["first"]: firsts[i - 1]["part"] for i, r in enumerate(firsts)}  # the first range's start goes to the last

    @F.pandas_udf("array<struct<part:long,ahead:boolean>>")
    def places(key: pd.Series) -> pd.Series:
        owns = np.searchsorted(bounds, key.to_numpy(), "right")
        out = []
        for k, part in zip(key.tolist(), owns.tolist()):
            to = [{"part": part, "ahead": False}]
            if k in starts:
                to.append({"part": starts[k], "ahead": True})
            out.append(to)
        return pd.Series(out)

    placed = keyed.select("doc_id", "text", "_key", F.explode(places("_key")).alias("to"))
    placed = placed.select("doc_id", "text", "_key", F.col("to.part").alias("part"), F.col("to.ahead").alias("ahead"))
    return placed.repartition(partitions, "part").sortWithinPartitions("part", "ahead", "_key", "text").drop("_key")


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)
_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None  # the document still waiting for its successor
    for batch in batches:
        out = []
        for doc_id, text, part, ahead in zip(*(batch.column(i) for i in range(4))):
            part, ahead = part.as_py(), ahead.as_py()
            if ahead and (before is None or before[0] != part):
                continue  # a repeated row of the next range's start
            text = text.as_py() or ""
            spots = spot_set(text)
            if before is not None and before[0] == part:
                _, last_id, last, last_spots = before
                edited = edited_text(last, text)
                edited_spots = spot_set(edited)
                out.append((
                    last_id, len(last), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(last_spots), fingerprint(edited_spots),
                    likeness(last_spots, edited_spots), likeness(last_spots, spots),
                ))
            before = None if ahead else (part, doc_id.as_py(), text, spots)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT)], schema=_RESULT)


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness and that to the next text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scans = docs.rdd.getNumPartitions()
    return with_following(docs, min(8 * scans, MOST_RANGES), 2 * scans).select("doc_id", "text", "part", "ahead").mapInArrow(_compare, RESULT)


# --- search over a corpus ---------------------------------------------------------------------------


def spot_signatures(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and the set as ``signatures array<long>``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [spot_set(t.as_py() or "") for t in part.column(1)]
                arrays = [part.column(0), pa.array(map(fingerprint, sets)), pa.array([s.view("i8") for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "fingerprint", "signatures"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, "doc_id long, fingerprint string, signatures array<long>")


def spotsig_pairs(sets: DataFrame, at_least: float = 0.8) -> DataFrame:
    """Pairs of distinct fingerprints (a, b, likeness) alike by ``at_least``; join ``sets`` for membership.

    Equal sets meet once, as one representative. Of the n signatures of a set only the n - ceil(n *
    at_least) + 1 that the fewest sets hold are looked up, inside partitions of neighbouring lengths.
    """
    one = sets.groupBy("fingerprint").agg(F.first("signatures").alias("s"))
    one = materialize(one.select("fingerprint", "s", F.size("s").alias("n")), "spotsets")
    spots = one.select("fingerprint", "n", F.explode("s").alias("sig"))
    often = spots.groupBy("sig").agg(F.count(F.lit(1)).alias("f"))
    ranked = spots.join(often, "sig").groupBy("fingerprint", "n").agg(F.sort_array(F.collect_list(F.struct("f", "sig"))).alias("r"))
    prefix = F.slice("r", F.lit(1), (F.col("n") - F.ceil(F.col("n") * at_least) + 1).cast("int"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / at_least))).cast("int")
    keys = ranked.select("fingerprint", "n", band.alias("band"), F.explode(F.transform(prefix, lambda x: x["sig"])).alias("sig"))
    keys = materialize(keys, "spotkeys")
    near = keys.select(F.col("fingerprint").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    other = keys.select(F.col("fingerprint").alias("b"), F.col("n").alias("nb"), "sig", "band")
    ahead = (F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))
    pairs = near.join(other, ["band", "sig"]).filter(ahead & (F.col("na") >= F.col("nb") * at_least)).select("a", "b").distinct()
    full = pairs.join(one.select(F.col("fingerprint").alias("a"), F.col("s").alias("sa")), "a").join(one.select(F.col("fingerprint").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return full.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("likeness")).filter(F.col("likeness") >= at_least)
