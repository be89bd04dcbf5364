"""Repeated byte strings removed by suffix sorting with a difference cover.

A string of ``WIDTH`` bytes goes if it starts earlier in the corpus. Where two such windows are equal, so are their
minimizers, the 32 bytes with the smallest hash in each. So windows are filed by minimizer, and all that can be
equal meet in one file; a minimizer's windows are one stretch of text, its context. Contexts whose minimizer
occurs once cannot hold a repeat and stay behind: a bitmap of bounded size, made from the counts of all
minimizers, tells which these are.

The contexts of a task's files are one text, whose suffixes are sorted by the difference cover of 3: triples at two
thirds of the places are sorted and named, the string of names is sorted the same way unless the names cover
``WIDTH`` bytes or differ throughout, and the suffixes left over, a third, are sorted by their first symbol and the
rank that follows and merged in. Equal windows are neighbours then; adjacent prefixes are compared byte by byte,
and of equal ones all but the earliest are covered.

Files are bounded: a minimizer that occurs over ``FILE_ROWS`` times is refiled window by window, under a hash of
the whole window, and a window leaves each slice of the corpus once. Nothing is dropped.

Edge cases: a null or empty text has no bytes; earlier means a smaller doc_id (nulls come last), of one doc_id the
smaller hash of its text, in one text the smaller start; rows with the same doc_id and text are one document and get
the same result each. An empty table gives no rows. Columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.tables import table
from memspark.session import materialize

WIDTH, GRAM = 100, 32
#: Bytes of text looked at together, rows of a file, and symbols sorted together (their names fit 21 bits).
SLICE_BYTES, FILE_ROWS, SORT_SYMBOLS = 1 << 21, 8192, (1 << 21) - 8
#: Bits of the bitmaps: 16 for each minimizer, at least and at most these (32 MB).
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
_PLACE = np.uint64((1 << 31) - 1)
_MIX = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


# --- suffix sorting ---------------------------------------------------------------------------------------


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1 of the keys, equal ones alike, and how many there are."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    ranks = np.empty(len(keys), np.uint64)
    ranks[order] = np.cumsum(np.r_[True, ordered[1:] != ordered[:-1]]) if len(keys) else 0
    return ranks, int(ranks.max(initial=0))


def _pack(*columns: np.ndarray) -> np.ndarray:
    key = columns[0]
    for c in columns[1:]:
        key = (key << np.uint64(21)) | c
    return key


def suffix_order(text: np.ndarray, depth: int, covers: int = 1) -> np.ndarray:
    """Starts of the suffixes of ``text`` (symbols from 1, 0 separates) in the order of their first ``depth`` bytes.

    ``covers``: bytes that one symbol stands for. Suffixes that agree so far come in any order.
    """
    n = len(text)
    t = np.concatenate([text.astype(np.uint64), np.zeros(3, np.uint64)])
    ones, twos, rest = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate([ones, twos])
    # sort and name the sampled triples
    names, distinct = _names(_pack(t[sample], t[sample + 1], t[sample + 2]))
    if distinct < len(sample) and covers * 3 < depth:
        # equal names may go on differently: sort the string of names
        nested = np.concatenate([names[: len(ones)], np.zeros(1, np.uint64), names[len(ones) :]])
        order = suffix_order(nested, depth, covers * 3)
        order = order[order != len(ones)]
        by_rank = sample[np.where(order > len(ones), order - 1, order)]
    else:
        by_rank = sample[np.argsort(names, kind="stable")]
    rank = np.zeros(n + 3, np.uint64)
    rank[by_rank] = np.arange(1, len(by_rank) + 1)
    # the suffixes left over, by their first symbol and the rank that follows
    keys = _pack(t[rest], rank[rest + 1])
    order = np.argsort(keys, kind="stable")
    rest, keys = rest[order], keys[order]
    # merge: each is compared with the sampled ones of either kind where both go on with a ranked suffix
    one, two = by_rank[by_rank % 3 == 1], by_rank[by_rank % 3 == 2]
    before = np.searchsorted(_pack(t[one], rank[one + 1]), keys)
    before += np.searchsorted(_pack(t[two], t[two + 1], rank[two + 2]), _pack(t[rest], t[rest + 1], rank[rest + 2]))
    merged = np.empty(n, np.int64)
    # suffixes alike beyond ``depth`` may stand in another order here and there
    places = np.maximum.accumulate(before) + np.arange(len(rest))
    free = np.ones(n, bool)
    free[places] = False
    merged[places] = rest
    merged[free] = by_rank
    return merged


def repeated_windows(parts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each part the starts of those windows that also start in an earlier part (or earlier in it)."""
    lengths = np.array([len(p) for p in parts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.frombuffer(b"\0".join(parts), np.uint8).astype(np.int64) + 1
    text[starts[1:] - 1] = 0
    order = suffix_order(text, width)
    whole = np.zeros(len(text) + 1, np.int64)  # places where a whole window starts
    long = lengths >= width
    whole[starts[long]] += 1
    whole[starts[long] + lengths[long] - width + 1] -= 1
    order = order[np.cumsum(whole)[order] > 0]
    if not len(order):
        return [np.zeros(0, np.int64) for _ in parts]
    # compare adjacent prefixes, eight bytes at a time
    plain = np.concatenate([np.frombuffer(b"\0".join(parts), np.uint8), np.zeros(8, np.uint8)])
    eights = np.ndarray((len(text),), "<u8", plain, strides=(1,))
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for shift in [*range(0, width - 8, 8), width - 8]:
        at = np.flatnonzero(same)
        same[at] = eights[a[at] + shift] == eights[b[at] + shift]
    first = np.flatnonzero(np.r_[True, ~same])
    least = np.minimum.reduceat(order, first)
    repeats = np.sort(order[order != np.repeat(least, np.diff(np.r_[first, len(order)]))])
    owner = np.searchsorted(starts, repeats, "right") - 1
    return np.split(repeats - starts[owner], np.searchsorted(owner, np.arange(1, len(parts))))


# --- contexts of minimizers -------------------------------------------------------------------------------


def contexts(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, first window, last window, minimizer) of each stretch of windows with one minimizer."""
    lengths = np.array([len(t) for t in texts], np.int64)
    n = int(lengths.sum())
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    if n < WIDTH:
        return none
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    eights = np.ndarray((n,), "<u8", data, strides=(1,))
    grams = n - GRAM + 1
    hashed = np.zeros(grams, np.uint64)
    for at in range(0, GRAM, 8):
        hashed = (hashed ^ eights[at : at + grams] * _MIX[0]) * _MIX[1]
        hashed ^= hashed >> np.uint64(29)
    hashed *= _MIX[2]
    hashed ^= hashed >> np.uint64(32)
    # the smallest of each window of grams, the leftmost of equal ones
    least = hashed & ~_PLACE | np.arange(grams, dtype=np.uint64)
    span, wide = 1, WIDTH - GRAM + 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if wide > span:
        least = np.minimum(least[: span - wide], least[wide - span :])
    place = (least & _PLACE).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    long = lengths >= WIDTH
    whole = np.zeros(n + 1, np.int64)
    whole[starts[long]] += 1
    whole[starts[long] + lengths[long] - WIDTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(whole[: len(place)]))
    if not len(at):
        return none
    place = place[at]
    new = np.flatnonzero(np.r_[True, (np.diff(place) != 0) | (np.diff(at) != 1)])
    low, high = at[new], at[np.r_[new[1:], len(at)] - 1]
    owner = np.searchsorted(starts, low, "right") - 1
    return owner, low - starts[owner], high - starts[owner], hashed[place[new]]


def _slices(texts: list[bytes], most: int) -> Iterator[slice]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def minimizer_counts(docs: DataFrame, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """How often each minimizer (``gram``) has a context in the corpus, for those that have more than one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for part in _slices(texts, slice_bytes):
                grams, counts = np.unique(contexts(texts[part])[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view("i8")), pa.array(counts.astype(np.int32))], names=["gram", "n"])

    found = docs.select("bytes").mapInArrow(run, "gram long, n int")
    return found.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")


class Bitmap:
    """Which minimizers may be in a set: never a false no. Of bounded size, made by Spark's bitmap aggregate."""

    def __init__(self, grams: DataFrame):
        bits = LEAST_BITS
        n = grams.count()
        while bits < min(16 * n, MOST_BITS):
            bits *= 2
        self.mask, self.some = np.uint64(bits - 1), n > 0
        bit = F.col("gram").bitwiseAND(F.lit(bits - 1)) + 1  # buckets count from 1
        rows = grams.select(bit.alias("bit")).groupBy(F.expr("bitmap_bucket_number(bit)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("held"))
        held = np.zeros(bits // 8, np.uint8)
        for r in rows.toLocalIterator():  # 4 KB for each of at most 8,192 buckets
            at = (r["bucket"] - 1) * 4096
            held[at : at + len(r["held"])] |= np.frombuffer(r["held"], np.uint8)
        self.held = held

    def has(self, grams: np.ndarray) -> np.ndarray:
        bit = grams & self.mask
        return self.held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1


_FILED = "file long, data binary, no_id boolean, doc long, th long, low long, high long"
_SPANS = "no_id boolean, doc long, th long, low long, high long"


def _spans(rows: list[tuple]) -> list[tuple]:
    """(key, low, high) rows merged where they touch."""
    out: list[tuple] = []
    for key, low, high in sorted(rows):
        if out and out[-1][0] == key and low <= out[-1][2]:
            out[-1] = (key, out[-1][1], max(high, out[-1][2]))
        else:
            out.append((key, low, high))
    return out


class Filing:
    """Contexts of one slice to send, the earliest of equal ones, and what the others cover."""

    def __init__(self):
        self.first: dict[bytes, tuple] = {}
        self.file: dict[bytes, int] = {}
        self.covered: list[tuple] = []

    def add(self, data: bytes, file: int, place: tuple) -> None:
        old = self.first.get(data)
        if old is not None:
            if place == old:
                return
            old, place = max(old, place), min(old, place)
            self.covered.append((old[0], old[1], old[1] + len(data)))
        self.first[data], self.file[data] = place, file

    def batch(self) -> pa.RecordBatch:
        rows = [(self.file[d], d, *key, low, low + len(d)) for d, (key, low) in self.first.items()]
        rows += [(key[2], None, *key, low, high) for key, low, high in _spans(self.covered)]
        columns = list(zip(*rows)) or [()] * 7
        types = [pa.int64(), pa.binary(), pa.bool_(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in _FILED.split(", ")])


def filed_contexts(docs: DataFrame, repeated: Bitmap, crowded: Bitmap, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Contexts whose minimizer is ``repeated``, under their file; those of ``crowded`` ones window by window.

    Rows without data are stretches that equal an earlier one of their slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            keys = list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))))
            for part in _slices(texts, slice_bytes):
                owner, low, high, gram = contexts(texts[part])
                at = np.flatnonzero(repeated.has(gram))
                crowd = crowded.has(gram[at]) if crowded.some else np.zeros(len(at), bool)
                filing = Filing()
                for o, a, b, g, split in zip((owner[at] + part.start).tolist(), low[at].tolist(), high[at].tolist(), gram[at].view("i8").tolist(), crowd.tolist()):
                    if not split:
                        filing.add(texts[o][a : b + WIDTH], g, (keys[o], a))
                        continue
                    for w in range(a, b + 1):
                        window = texts[o][w : w + WIDTH]
                        filing.add(window, xxhash.xxh64_intdigest(window) - (1 << 63), (keys[o], w))
                yield filing.batch()

    return docs.select("bytes", "no_id", "doc", "th").mapInArrow(run, _FILED)


def sorted_spans(filed: DataFrame, sort_symbols: int = SORT_SYMBOLS) -> DataFrame:
    """Stretches (no_id, doc, th, low, high) covered by windows that start earlier."""
    order = ["file", "data", "no_id", "doc", "th", "low"]
    filed = filed.repartition("file").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[tuple] = []  # (place, data) of finished files with more than one context
        current: list[tuple] = []
        size, file, last, kept = 0, None, None, None

        def emit(covered: list[tuple]) -> pa.RecordBatch:
            rows = [(*key, low, high) for key, low, high in covered]
            columns = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.bool_(), *[pa.int64()] * 4])], names=[c.split()[0] for c in _SPANS.split(", ")])

        def solve() -> list[tuple]:
            if not whole:
                return []
            whole.sort()
            found = repeated_windows([d for _, d in whole])
            rows = [(key, low + w, low + w + WIDTH) for ((key, low), _), ws in zip(whole, found) for w in ws.tolist()]
            whole.clear()
            return _spans(rows)

        def close() -> list[tuple]:
            """The current file is complete."""
            nonlocal size
            out: list[tuple] = []
            if len(current) > 1:
                more = sum(len(d) + 1 for _, d in current)
                if size + more > sort_symbols:
                    out, size = solve(), 0
                whole.extend(current)
                size += more
            current.clear()
            return out

        for batch in batches:
            covered: list[tuple] = []
            for f, data, no_id, doc, th, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                key = (no_id, doc, th)
                if data is None:
                    covered.append((key, low, high))
                    continue
                if f != file:
                    covered += close()
                    file, last = f, None
                if data == last:  # equal contexts are neighbours, the earliest first
                    if (key, low) != kept:
                        covered.append((key, low, high))
                    continue
                last, kept = data, (key, low)
                current.append((kept, data))
            if covered:
                yield emit(covered)
        rest = close() + solve()
        if rest:
            yield emit(rest)

    return filed.mapInArrow(run, _SPANS)


def remove_repeats(docs: DataFrame, *, file_rows: int = FILE_ROWS, slice_bytes: int = SLICE_BYTES, sort_symbols: int = SORT_SYMBOLS) -> DataFrame:
    """doc_id, ``n_bytes``, the removed ``spans`` (low, high; maximal) and the ``kept`` bytes of every row."""
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("bytes"),
    ).select("doc_id", "bytes", F.isnull("doc_id").alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc"), F.xxhash64("bytes").alias("th"))
    long = keyed.filter(F.length("bytes") >= WIDTH)
    counts = materialize(minimizer_counts(long, slice_bytes), "minimizers")
    repeated, crowded = Bitmap(counts), Bitmap(counts.filter(F.col("n") > file_rows))
    spans = sorted_spans(filed_contexts(long, repeated, crowded, slice_bytes), sort_symbols)
    keys = ["no_id", "doc", "th"]
    of_text = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span_type = pa.struct([("low", pa.int64()), ("high", pa.int64())])
        for batch in batches:
            spans, kept, sizes = [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                merged = _spans([(0, s["low"], s["high"]) for s in found or ()])
                edges = [0, *(x for _, low, high in merged for x in (low, high)), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"low": low, "high": high} for _, low, high in merged])
                sizes.append(len(text))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(span_type)), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept"])

    joined = keyed.join(of_text, keys, "left").select("doc_id", "bytes", "found")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<low: long, high: long>>, kept binary")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda sum_, s: sum_ + s["high"] - s["low"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
