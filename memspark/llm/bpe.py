"""BPE by dynamic programming over prefixes.

Every prefix of a word has exactly one last token in its encoding. An automaton with suffix links over
the vocabulary reports, prefix by prefix, every token that is a suffix of it; the one whose pair with the
last token of the remaining shorter prefix is *compatible* is stored. Two tokens are compatible if the
merge rules, applied to their symbols side by side, never merge across the border. Following the stored
tokens back from the end gives the exact ids, in time linear in the word and without a merge queue.

Edge cases: a null text is empty, an empty text has no tokens (the digests of the empty string); special
tokens met in a text take their single id. Repeated rows are encoded each; an empty table gives no rows.
Columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from memspark.llm.tables import table
from memspark.llm.wordchunks import ChunkCoder, chunks_of, slices, word_pattern, words_of

_END = "</w>"
#: The last symbol of a word is another symbol than the same byte inside one.
_END_SHIFT = 0x1000
_PAIR_MEMORY = 500_000
_NEVER = 1 << 40

OUTPUTS = {
    "ids": (pa.list_(pa.int32()), "array<int>"), "decoded": (pa.string(), "string"), "n_tokens": (pa.int64(), "long"),
    "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string"),
}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class PrefixBpe:
    """The merge rules of one tokenizer file, with the suffix matcher over its vocabulary."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.find_words = word_pattern()
        self.bytes_to_symbols = {b: s for b, s in enumerate(byte_symbols())}
        size = max(self.names) + 1
        self.left, self.right, self.rank = [-1] * size, [-1] * size, [-1] * size
        self.merges: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.left[made], self.right[made], self.rank[made] = left, right, rank
            self.merges[left << 20 | right] = rank
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for made in sorted(vocab.values(), key=lambda i: self.rank[i]):
            if self.left[made] < 0 or self._apart(self.left[made], self.right[made], whole=False):
                name = self.names[made]
                symbols = name[: -len(_END) - 1] + chr(ord(name[-len(_END) - 1]) + _END_SHIFT) if name.endswith(_END) and len(name) > len(_END) else name
                self.automaton.add_word(symbols, (made, len(symbols)))
        self.automaton.make_automaton()

    def _apart(self, a: int, b: int, whole: bool = True) -> bool:
        """Whether no merge crosses the border of ``a`` and ``b``; ``whole`` includes that of the two themselves.

        Both tokens grow towards the border in the order of their merges' ranks. A merge across comes
        first if it ranks below the next one on the left, or not above the next one on the right.
        """
        at, bt = [a], [b]
        while self.right[at[-1]] >= 0:
            at.append(self.right[at[-1]])
        while self.left[bt[-1]] >= 0:
            bt.append(self.left[bt[-1]])
        i, j = len(at) - 1, len(bt) - 1
        while True:
            next_a = self.rank[at[i - 1]] if i else _NEVER
            next_b = self.rank[bt[j - 1]] if j else _NEVER
            if i == j == 0 and not whole:
                return True
            across = self.merges.get(at[i] << 20 | bt[j], _NEVER)
            if across < next_a and across <= next_b:
                return False
            if i == j == 0:
                return True
            if next_a <= next_b:
                i -= 1
            else:
                j -= 1

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= _PAIR_MEMORY:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b)
        return known

    def encode_word(self, word: str) -> list[int]:
        symbols = word.encode("utf-8").decode("latin-1").translate(self.bytes_to_symbols)
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + _END_SHIFT)
        last: list = [None] * (len(symbols) + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, found in self.automaton.iter(symbols):
            if last[end + 1] is None:
                token, size = found
                before = end + 1 - size
                if before:
                    previous = last[before][0]
                    fits = pairs.get(previous << 20 | token)
                    if not (compatible(previous, token) if fits is None else fits):
                        continue
                last[end + 1] = found
        ids, at = [], len(symbols)
        while at:
            token, size = last[at]
            ids.append(token)
            at -= size
        ids.reverse()
        return ids

    def parts_of(self, chunk: str) -> list[str]:
        """Words and special tokens of a text without white space."""
        if "<" in chunk and self.special_split is not None and self.special_split.search(chunk):
            parts = []
            for part in self.special_split.split(chunk):
                parts += [part] if part in self.special else words_of(part, self.find_words)
            return parts
        return words_of(chunk, self.find_words)

    def encode_part(self, part: str) -> list[int]:
        return [self.special[part]] if part in self.special else self.encode_word(part)

    def encode_chunk(self, chunk: str) -> list[int]:
        """Ids of a text without white space."""
        return [i for part in self.parts_of(chunk) for i in self.encode_part(part)]


_LOADED: dict[str, tuple[ChunkCoder, list[bytes]]] = {}


def loaded(path: str) -> tuple[ChunkCoder, list[bytes]]:
    """The coder of this worker and the name of each id."""
    if path not in _LOADED:
        bpe = PrefixBpe(path)

        def encode_words(words: list[str]) -> list[bytes]:
            return [array("I", bpe.encode_word(w)).tobytes() for w in words]

        def encode_text(text: str) -> bytes:
            return array("I", [i for c in chunks_of(text) for i in bpe.encode_chunk(c)]).tobytes()

        names = [bpe.names.get(i, "").encode() for i in range(max(bpe.names) + 1)]
        _LOADED[path] = ChunkCoder(encode_words, encode_text, list(bpe.special)), names
    return _LOADED[path]


def bpe_encode(docs: DataFrame, path: str, outputs: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode whole texts: the id and the chosen ``OUTPUTS``.

    ``decoded`` joins the tokens' names by blanks, as a tokenizer file without decoder has it.
    """
    rows = docs.select(id_col, text_col)
    id_type = rows.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {id_type}", *[f"{o} {OUTPUTS[o][1]}" for o in outputs]])

    def one(coded: bytes, numbers: list[bytes], names: list[bytes]) -> dict:
        ids = array("I", coded)
        row = {"n_tokens": len(ids), "ids": ids}
        if "ids_sha256" in outputs:
            row["ids_sha256"] = hashlib.sha256(b" ".join([numbers[i] for i in ids])).hexdigest()
        if "decoded" in outputs or "decoded_sha256" in outputs:
            decoded = b" ".join([names[i] for i in ids])
            row["decoded"], row["decoded_sha256"] = decoded, hashlib.sha256(decoded).hexdigest()
        return {o: row[o] for o in outputs}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, names = loaded(path)
        numbers = [b"%d" % i for i in range(len(names))]
        for batch in batches:
            for part in slices(batch, 1):
                rows = [one(coded, numbers, names) for coded in coder.encode(part.column(1))]
                columns = [part.column(0), *[pa.array([r[o] for r in rows], OUTPUTS[o][0]) for o in outputs]]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *outputs])

    return rows.mapInArrow(encode, schema)


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe_encode(table(spark, sf_dir, "documents"), path, ["n_tokens", "ids_sha256", "decoded_sha256"])
