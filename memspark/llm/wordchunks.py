"""Texts as white-space chunks with a bounded memory of what was computed for each.

The word tokenizer's rules never look across white space (its normal form, lower case, splits and merges
all stay inside a chunk), so a text's result is the sequence of its chunks' results, and a chunk met
again costs one look-up.
"""

from __future__ import annotations

import ctypes
import re
import unicodedata
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the Unicode property: what ``str.split`` knows without these four.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Keys and bytes of one generation of a memory. A key and its value count with what Python adds to them.
MEMORY_ENTRIES, MEMORY_BYTES, OVERHEAD = 250_000, 24 << 20, 160
#: Longer chunks are computed each time, so the memory stays bounded in bytes.
MEMORY_CHARS = 100
#: Text handled at once by a ``ChunkCoder``.
SLICE_BYTES = 8 << 20
ID_BYTES = 4


def chunks_of(text: str) -> list[str]:
    if _SEPARATORS.search(text):
        return [c for c in _WHITE.split(text) if c]
    return text.split()


class Memory(dict):
    """``memory[key]`` computes on first sight. A full memory becomes the old generation, from which what is
    met again moves on, so common keys stay and rare ones go after two generations at most."""

    __hash__ = object.__hash__

    def __init__(self, compute: Callable[[str], object], entries: int = MEMORY_ENTRIES, most_bytes: int = MEMORY_BYTES):
        super().__init__()
        self.compute, self.entries, self.most_bytes, self.old, self.held = compute, entries, most_bytes, {}, 0
        _LIVE.add(self)

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.keep(key, value)
        return value

    def _turn(self) -> None:
        self.old, self.held = dict(self), 0
        self.clear()

    def keep(self, key: str, value) -> None:
        if len(key) <= MEMORY_CHARS:
            if len(self) >= self.entries or self.held > self.most_bytes:
                self._turn()
            self.held += OVERHEAD + len(key) + _size(value)
            self[key] = value

    def keep_all(self, items: dict) -> None:
        """Keep many values of bytes at once; the caller leaves long keys out."""
        if len(self) + len(items) > self.entries or self.held > self.most_bytes:
            self._turn()
        self.held += OVERHEAD * len(items) + sum(map(len, items)) + sum(map(len, items.values()))
        self.update(items)

    def forget(self) -> None:
        self.clear()
        self.old, self.held = {}, 0


_LIVE: weakref.WeakSet = weakref.WeakSet()


def _size(value) -> int:
    return len(value) * (1 if isinstance(value, (bytes, str)) else 32) if hasattr(value, "__len__") else 8


def forget_all() -> None:
    """Workers live on from one operator to the next: those that use no memory give back what others remembered.

    What is free goes back to the system too, as Arrow and the C library keep it for this process alone.
    """
    for memory in list(_LIVE):
        memory.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only the GNU library has it
    if trim is not None:
        trim(0)


def words_of(chunk: str, find_words: Callable[[str], list[str]]) -> list[str]:
    """The tokenizer's words in a chunk: normal form C, lower case, then its word pattern."""
    plain = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
    return [plain] if plain.isalpha() else find_words(plain)


def word_pattern():
    """Finds all words of the word tokenizer in lower-cased text."""
    import regex

    # fixed: the word pattern of the tokenizer file, with white space spelled out
    return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall


def slices(batch: pa.RecordBatch, column: int, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have at most ``most_bytes`` (or are one row)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = held = 0
    for row, size in enumerate(sizes):
        if held + size > most_bytes and row > start:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


class ChunkCoder:
    """Ids of Arrow arrays of whole texts; what stands often in a slice is encoded once.

    ``encode_words`` gives the ids of many lower-cased words as little-endian 32-bit bytes each, ``encode_text``
    those of any one text. ``special`` are the special tokens.
    """

    #: What Arrow and Python know alike in any Unicode version.
    _common = re.compile("[\\x00-\\u052f\\u2010-\\u2027\\u2030-\\u205e]*")

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], encode_text: Callable[[str], bytes], special: list[str], entries: int = 400_000):
        self.encode_words, self.encode_text = encode_words, encode_text
        # texts that Arrow would split or lower-case otherwise than the library, or that may hold special tokens
        self.odd = "|".join([r"[\x1c-\x1f\x{130}\x{1c89}\x{a7cb}\x{a7cc}\x{a7da}\x{a7dc}\x{10d50}-\x{10d65}]", *[re.escape(t[:2]) for t in special]])
        self.find_words = word_pattern()
        self.memory = Memory(encode_text, entries)  # of words and of chunks

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """Ids of chunks, and of the words in them, that the memory lacks."""
        common, find_words, memory = self._common.fullmatch, self.find_words, self.memory
        ids, parts, unknown = {}, {}, []
        for at in range(0, len(new), 1000):
            some = new[at : at + 1000]
            if not common("".join(some)):  # Unicode versions may differ on what a letter is: such chunks are encoded one by one
                ids.update((c, self.encode_text(c)) for c in some if not common(c))
                some = [c for c in some if c not in ids]
            for c in some:
                if c.isalpha():
                    unknown.append(c)
                else:
                    parts[c] = find_words(c)
        words = {w for part in parts.values() for w in part}
        words.difference_update(unknown)
        for w in words:
            value = memory.get(w) or memory.old.get(w)
            if value is None:
                unknown.append(w)
            else:
                ids[w] = value
        for at in range(0, len(unknown), 1000):
            some = unknown[at : at + 1000]
            ids.update(zip(some, self.encode_words(some)))
        for c, part in parts.items():
            if part != [c]:
                ids[c] = b"".join([ids[w] for w in part])
        return ids

    def _recall(self, keys: list[str]) -> list[bytes]:
        memory = self.memory
        found = list(map(memory.get, keys))
        gaps = [i for i, value in enumerate(found) if value is None]
        old, new, fresh = memory.old, [], {}
        for i in gaps:
            value = found[i] = old.get(keys[i])
            if value is None:
                new.append(i)
            else:
                fresh[keys[i]] = value
        if new:
            ids = self._learn([keys[i] for i in new])
            for i in new:
                found[i] = ids[keys[i]]
            fresh.update(ids)
        if fresh:
            long = [k for k in fresh if len(k) > MEMORY_CHARS]
            for k in long:
                del fresh[k]
            memory.keep_all(fresh)
        return found

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        texts = texts.fill_null("")
        strange = pc.match_substring_regex(texts, self.odd)
        if not pc.any(strange).as_py():
            return self._encode_plain(texts)
        plain = iter(self._encode_plain(texts.filter(pc.invert(strange))))
        return [self.encode_text(t.as_py()) if s else next(plain) for t, s in zip(texts, strange.to_pylist())]

    def _encode_plain(self, texts: pa.StringArray) -> list[bytes]:
        whole = texts.to_pylist()
        if not all(unicodedata.is_normalized("NFC", t) for t in whole):
            texts = pa.array([unicodedata.normalize("NFC", t) for t in whole], pa.string())
        del whole
        chunks = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        coded = chunks.flatten().dictionary_encode()
        found = self._recall(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy()
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int32, len(found)) // ID_BYTES
        # every chunk's ids stand once in the pool; gather them in text order
        each = sizes[at]
        ends_at = np.cumsum(each, dtype=np.int64)
        total = int(ends_at[-1]) if len(ends_at) else 0
        kind = np.int32 if total < 1 << 31 else np.int64
        places = np.repeat(((np.cumsum(sizes, dtype=np.int64) - sizes)[at] - (ends_at - each)).astype(kind), each)
        places += np.arange(total, dtype=kind)
        ids = pool[places].tobytes()
        stops = np.concatenate([[0], ends_at])[chunks.offsets.to_numpy() - chunks.offsets[0].as_py()] * ID_BYTES
        return [ids[a:b] for a, b in zip(stops.tolist(), stops[1:].tolist())]
