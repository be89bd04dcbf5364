"""Packing tokenised documents into fixed windows, online and in bounded space.

Each partition keeps a fixed number of open windows. A document goes into the fullest window that still
takes it whole; if none does and all places are taken, the fullest window is emitted and a new one opened.
Documents longer than a window are cut into full windows and a rest. The windows left open at the end of
the partitions are merged in groups: the fullest is topped up with pieces of the emptiest, cut where it is
full, so each group ends with at most one window that is not full; those meet in the next round, until one
group is left. At most ``GROUP`` partitions' open windows (some 4 MB of ids) meet in one task.

Edge cases: a null or empty text is its end id alone; repeated rows are packed each; an empty table gives no
rows; ids of any length are cut. Columns other than the two named are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.tables import table
from memspark.llm.wordchunks import ID_BYTES as _ID_BYTES
from memspark.llm.wordchunks import ChunkCoder, slices
from memspark.session import materialize

CAPACITY = 4096
OPEN_WINDOWS = 32
#: Partitions whose open windows are merged in one task.
GROUP = 8
END_ID = 2
#: A sequence id is made of the round, the partition or group, and a count within it.
_ROUND_SHIFT, _PART_SHIFT = 58, 30

_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
    ("offset", pa.int64()), ("part", pa.int64()), ("open", pa.bool_()), ("ids", pa.binary()),
])
PIECES_SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, open boolean, ids binary"
)

_LOADED: dict[str, tuple] = {}


def encoder(path: str):
    """``encode(texts)`` gives the ids of an Arrow array of texts as little-endian 32-bit bytes each.

    The library sees every word once per memory, many in a call; it runs on one thread, as Spark has the cores.
    """
    if path not in _LOADED:
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        width = tokenizer.get_vocab_size()
        ends = np.zeros(width, bool)  # every word's last token, and no other, carries the end mark
        ends[[i for t, i in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

        def encode_words(words: list[str]) -> list[bytes]:
            """Ids of many words by one call of the library, cut where a token ends a word."""
            ids = np.array(tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) != len(words):
                raise ValueError("the tokenizer split a word")
            raw, stops = ids.tobytes(), (cuts * _ID_BYTES).tolist()
            return [raw[a:b] for a, b in zip([0, *stops], stops)]

        def one(text: str) -> bytes:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        _LOADED[path] = ChunkCoder(encode_words, one, special).encode
    return _LOADED[path]


class OpenWindows:
    """Best fit over a fixed number of open windows."""

    def __init__(self, capacity: int, places: int):
        self.capacity, self.places = capacity, places
        self.fills: list[tuple[int, int]] = []
        self.content: dict[int, list] = {}
        self.made = 0

    def place(self, size: int, piece) -> list[list]:
        """Put a piece of at most ``capacity`` somewhere; returns windows that are done."""
        done = []
        at = bisect.bisect_right(self.fills, (self.capacity - size, 1 << 62)) - 1
        if at >= 0:
            fill, window = self.fills.pop(at)
        else:
            if len(self.fills) >= self.places:
                done.append(self.content.pop(self.fills.pop()[1]))
            fill, window = 0, self.made
            self.made += 1
            self.content[window] = []
        self.content[window].append(piece)
        if fill + size == self.capacity:
            done.append(self.content.pop(window))
        else:
            bisect.insort(self.fills, (fill + size, window))
        return done


class _Rows:
    """Collects piece rows and hands them out as batches."""

    def __init__(self, with_ids: bool):
        self.with_ids, self.rows, self.held = with_ids, [], 0

    def window(self, pieces: list, sequence_id: int, part: int, open_: bool) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            n = len(ids) // _ID_BYTES
            keep = ids if open_ or self.with_ids else None
            self.rows.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, sequence_id, offset, part, open_, keep))
            self.held += 80 + len(keep or b"")
            offset += n

    def batches(self, at_least: int) -> Iterator[pa.RecordBatch]:
        if self.rows and self.held >= at_least:
            columns = list(zip(*self.rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)
            self.rows, self.held = [], 0


def pack_partitions(docs: DataFrame, path: str, capacity: int, places: int, end_id: int, with_ids: bool) -> DataFrame:
    """Pieces of every document; windows still open carry their ids."""
    end = end_id.to_bytes(_ID_BYTES, "little")
    most = capacity * _ID_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, windows, rows, made = encoder(path), OpenWindows(capacity, places), _Rows(with_ids), 0

        def sequence() -> int:
            nonlocal made
            made += 1
            return part << _PART_SHIFT | made - 1

        for batch in batches:
            for piece in slices(batch, 1):
                for doc_id, ids in zip(piece.column(0).to_pylist(), encode(piece.column(1))):
                    ids += end
                    tokens, start = len(ids) // _ID_BYTES, 0
                    while len(ids) - start >= most:
                        rows.window([(doc_id, start // _ID_BYTES, ids[start : start + most], tokens)], sequence(), part, False)
                        start += most
                    if start < len(ids):
                        for done in windows.place(tokens - start // _ID_BYTES, (doc_id, start // _ID_BYTES, ids[start:], tokens)):
                            rows.window(done, sequence(), part, False)
                yield from rows.batches(4 << 20)
        for left in windows.content.values():
            rows.window(left, sequence(), part, True)
        yield from rows.batches(0)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, PIECES_SCHEMA)


def top_up(windows: list[list], capacity: int) -> list[list]:
    """The pieces of ``windows`` in as few windows: the fullest take from the emptiest; only the last stays open."""
    most = capacity * _ID_BYTES
    size = lambda w: sum(len(p[2]) for p in w)
    order = sorted(windows, key=size, reverse=True)
    out, low = [], len(order) - 1
    for high, window in enumerate(order):
        if high > low:
            break
        room = most - size(window)
        while room and low > high:
            doc_id, start, ids, tokens = order[low].pop()
            if len(ids) > room:
                order[low].append((doc_id, start, ids[:-room], tokens))
                start, ids = start + (len(ids) - room) // _ID_BYTES, ids[-room:]
            window.append((doc_id, start, ids, tokens))
            room -= len(ids)
            if not order[low]:
                low -= 1
        out.append(window)
    return out


def merge_open(left: DataFrame, round_: int, group: int, capacity: int, with_ids: bool) -> DataFrame:
    """One merging round over open windows; ``part`` becomes the group."""

    def merge(pieces: pa.Table) -> pa.Table:
        found: dict[int, list] = {}
        part = 0
        for r in pieces.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist():
            found.setdefault(r["sequence_id"], []).append((r["doc_id"], r["start"], r["ids"], r["doc_tokens"]))
            part = r["part"]
        rows = _Rows(with_ids)
        for n, window in enumerate(top_up(list(found.values()), capacity)):
            full = sum(len(p[2]) for p in window) == capacity * _ID_BYTES
            rows.window(window, round_ << _ROUND_SHIFT | part << _PART_SHIFT | n, part, not full)
        return pa.Table.from_batches(rows.batches(0), _PIECES)

    return left.withColumn("part", F.floor(F.col("part") / group).cast("long")).groupBy("part").applyInArrow(merge, PIECES_SCHEMA)


def pack_documents(
    docs: DataFrame, path: str, *, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, group: int = GROUP, with_ids: bool = False
) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) of all documents.

    ``ids`` holds the piece's little-endian 32-bit ids if asked for, else null.
    """
    packed = materialize(pack_partitions(docs, path, capacity, open_windows, end_id, with_ids), "packed")
    out = packed.filter(~F.col("open"))
    left = packed.filter("open")
    parts = left.agg(F.max("part")).first()[0]
    round_ = 0
    while parts is not None:
        round_ += 1
        merged = materialize(merge_open(left, round_, group, capacity, with_ids), "merged")
        out = out.unionByName(merged.filter(~F.col("open")))
        left = merged.filter("open")
        if parts < group:
            break
        parts //= group
    out = out.unionByName(left)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")


def op6_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")
