"""Periodic runs of words by way of a grammar.

The word ids of a text are compressed by Re-Pair: the most frequent pair of neighbours becomes a nonterminal,
again and again, until no pair occurs twice; what is left is the start rule, cut in halves into a balanced
tree. Every run has one lowest node of the derivation that holds all of it, and crosses that node's boundary. So
the runs crossing a boundary are computed once for each nonterminal, from how far equal words reach to both
sides at every period, moved to all places where it is derived, and those inside longer ones are dropped.

Only texts that can hold a run are compressed. Inside a run of period q all words but the first q stand at most
q words after the same word, so a text without a long enough stretch of such words, at any period, has no run.

Edge cases: a null text has no words; a null doc_id is returned as it is; every row counts for itself, repeated
ones too; an empty table gives no rows. Columns other than the two named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.tables import table

#: Shortest run in words, and in periods.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: (node, period) questions answered at once.
ASKED = 1 << 20
_PRIMES, _BASES = (2147483647, 2147483629), (1103515245, 1540483477)
_FAR = 1 << 40


def may_repeat(ids: np.ndarray) -> bool:
    """False only if no run is possible."""
    n = len(ids)
    if n < LEAST_WORDS:
        return False
    order = np.argsort(ids, kind="stable")
    again = ids[order[1:]] == ids[order[:-1]]
    if again.sum() < LEAST_WORDS - 1:
        return False
    gap = np.full(n, _FAR)
    gap[order[1:][again]] = (order[1:] - order[:-1])[again]
    reach = 1
    while True:
        period = reach // 2 + 1  # the least one that this round looks for, up to ``reach``
        need = max(LEAST_WORDS - period, (LEAST_TIMES - 1) * period)
        if need + period > n:
            return False
        breaks = np.flatnonzero(gap > reach)  # the first word is one
        if len(breaks) == 0 or max(np.diff(breaks).max(initial=0) - 1, n - 1 - breaks[-1]) >= need:
            return True
        reach *= 2


def repair(ids: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Rules (left, right), numbered on from the largest id, and the start sequence."""
    n, first = len(ids), int(ids.max()) + 1 if len(ids) else 0
    seq, nxt, prv = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    codes = ids[:-1] * first + ids[1:]
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) > 0]) if n > 1 else np.zeros(0, int)
    places: dict[tuple[int, int], set[int]] = {}
    for at in np.split(order, starts[1:]) if n > 1 else []:
        if len(at) > 1:
            p = int(at[0])
            places[seq[p], seq[p + 1]] = set(at.tolist())
    heap = [(-len(at), pair) for pair, at in places.items()]
    heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heappop(heap)
        at = places.get(pair)
        if at is None or len(at) < 2:
            continue
        if len(at) != -count:
            heappush(heap, (-len(at), pair))
            continue
        a, b = pair
        symbol, fresh = first + len(rules), set()
        rules.append(pair)
        for p in sorted(at):
            q = nxt[p]
            if seq[p] != a or q >= n or seq[q] != b:  # taken by an overlapping occurrence
                continue
            before, after = prv[p], nxt[q]
            if before >= 0 and (old := places.get((seq[before], a))) is not None and old is not at:
                old.discard(before)
            if after < n and (old := places.get((b, seq[after]))) is not None and old is not at:
                old.discard(q)
            seq[p], seq[q], nxt[p] = symbol, -1, after
            if before >= 0:
                places.setdefault(key := (seq[before], symbol), set()).add(before)
                fresh.add(key)
            if after < n:
                prv[after] = p
                places.setdefault(key := (symbol, seq[after]), set()).add(p)
                fresh.add(key)
        del places[pair]
        for key in fresh:
            if len(places[key]) > 1:
                heappush(heap, (-len(places[key]), key))
    return rules, [s for s in seq if s >= 0]


class Reach:
    """How far words agree forwards or backwards from two places, by hashes of stretches."""

    _powers = [np.ones(1, np.uint64) for _ in _PRIMES]

    def __init__(self, ids: np.ndarray):
        self.n, self.sums, self.powers = len(ids), [], []
        for i, (prime, base) in enumerate(zip(_PRIMES, _BASES)):
            power = Reach._powers[i]
            while len(power) <= self.n:
                step = np.uint64(pow(base, len(power), prime))
                power = np.concatenate([power, power * step % np.uint64(prime)])
            Reach._powers[i] = power
            values = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(base) % np.uint64(prime)
            self.powers.append(power)
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * power[: self.n] % np.uint64(prime)) % np.uint64(prime)]))

    def _same(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches of ``length`` at i < j are equal."""
        equal = np.ones(len(i), bool)
        for prime, power, sums in zip(_PRIMES, self.powers, self.sums):
            p = np.uint64(prime)
            left = (sums[i + length] + p - sums[i]) % p * power[j - i] % p
            equal &= left == (sums[j + length] + p - sums[j]) % p
        return equal

    def _grow(self, limit: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        got = np.zeros(len(limit), np.int64)
        step = 1 << int(limit.max(initial=0)).bit_length()
        while step := step >> 1:
            at = np.flatnonzero(got + step <= limit)
            at = at[same(at, got[at] + step)]
            got[at] += step
        return got

    def forward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return self._grow(limit, lambda at, length: self._same(i[at], j[at], length))

    def backward(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        return self._grow(limit, lambda at, length: self._same(i[at] - length, j[at] - length, length))


def crossing(ids: np.ndarray, reach: Reach, low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(node, start, end, period) of the long enough stretches in each [low, high) that cross ``middle``."""
    most = (high - low) // LEAST_TIMES
    found = []
    edges = np.searchsorted(np.cumsum(most), np.arange(0, most.sum() + ASKED, ASKED), "left")
    for a, b in zip([0, *edges[1:]], [*edges[1:], len(most)]):
        node = np.repeat(np.arange(a, b), most[a:b])
        period = np.arange(len(node)) - np.repeat(np.cumsum(most[a:b]) - most[a:b], most[a:b]) + 1
        for shift in (0, 1):  # one period to the right of the boundary, or to the left of it
            left = middle[node] - shift * period
            right = left + period
            # a stretch that crosses and holds a period on this side has equal words here
            fits = np.flatnonzero((left >= low[node]) & (right <= high[node]))
            probe = left[fits] - 1 + shift
            fits = fits[ids[probe] == ids[probe + period[fits]]]
            at, q, i, j = node[fits], period[fits], left[fits], right[fits]
            start = i - reach.backward(i, j, i - low[at])
            end = j + reach.forward(i, j, high[at] - j)
            long = end - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * q)
            found.append((at[long], start[long], end[long], q[long]))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4


def runs_of(ids: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period."""
    ids = np.asarray(ids, np.int64)
    if not may_repeat(ids):
        return np.zeros((0, 3), np.int64)
    rules, start = repair(ids)
    first = int(ids.max()) + 1
    size = [1] * first
    for a, b in rules:
        size.append(size[a] + size[b])
    length = np.array([size[s] for s in start])
    begin = np.cumsum(length) - length
    # places of every nonterminal, from the start rule downwards
    places: list[list[np.ndarray]] = [[] for _ in rules]
    symbols = np.array(start)
    for s in np.unique(symbols[symbols >= first]).tolist():
        places[s - first].append(begin[symbols == s])
    derived = [np.zeros(0, np.int64)] * len(rules)
    for r in range(len(rules) - 1, -1, -1):
        derived[r] = at = np.concatenate(places[r]) if places[r] else np.zeros(0, np.int64)
        for symbol, shift in zip(rules[r], (0, size[rules[r][0]])):
            if symbol >= first and len(at):
                places[symbol - first].append(at + shift)
    live = [r for r in range(len(rules)) if len(derived[r])]
    low = [int(derived[r][0]) for r in live]
    middle = [p + size[rules[r][0]] for p, r in zip(low, live)]
    high = [p + size[first + r] for p, r in zip(low, live)]
    where = [derived[r] - p for p, r in zip(low, live)]
    # the start rule as a balanced tree, level by level
    while len(begin) > 1:
        ends = np.r_[begin[1:], len(ids)]
        pairs = len(begin) // 2 * 2
        low += begin[0:pairs:2].tolist()
        middle += begin[1:pairs:2].tolist()
        high += ends[1:pairs:2].tolist()
        begin = begin[0::2]
    node, s, e, q = crossing(ids, Reach(ids), np.array(low, np.int64), np.array(middle, np.int64), np.array(high, np.int64))
    moved = [where[i] if i < len(where) else np.zeros(1, np.int64) for i in node.tolist()]
    counts = [len(m) for m in moved]
    shift = np.concatenate(moved) if moved else np.zeros(0, np.int64)
    s, e, q = np.repeat(s, counts) + shift, np.repeat(e, counts) + shift, np.repeat(q, counts)
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    # within a period what ends no later than an earlier start's stretch lies inside it
    ends = q * (len(ids) + 1) + e
    keep = ends > np.r_[-1, np.maximum.accumulate(ends)[:-1]] if len(ends) else np.zeros(0, bool)
    s, e, q = s[keep], e[keep], q[keep]
    # the same stretch with a multiple of its period
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    keep = np.r_[True, (np.diff(s) != 0) | (np.diff(e) != 0)] if len(s) else np.zeros(0, bool)
    s, e, q = s[keep], e[keep], q[keep]
    order = np.lexsort((q, s))
    return np.stack([s, e - s, q], axis=1)[order]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words are not in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 text; bytes split at the six ASCII blanks alone."""
    return text.split()


def document_runs(docs: DataFrame, order_of: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, ``runs`` (start, length, period), ``best`` (the run with the most periods; ties: smallest start, then
    period) and ``collapsed``, the words outside the repeated parts of runs, of every text.

    ``order_of(doc_id, n)`` may give the places of the words to take in place of the n words as they stand.
    """

    def one(doc_id: int | None, text: bytes) -> tuple[list[tuple], tuple | None, bytes]:
        words = words_of(text)
        places = order_of(doc_id, len(words)) if order_of else None
        if places is not None:
            words = [words[i] for i in places.tolist()]
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        runs = runs_of(ids)
        if not len(runs):
            return [], None, b" ".join(words)
        listed = [tuple(r) for r in runs.tolist()]
        best = max(listed, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        return listed, best, b" ".join([words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()])

    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = [f.name for f in run_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                found = [one(i, t or b"") for i, t in zip(part.column(0).to_pylist(), texts)]
                runs = pa.array([[dict(zip(names, r)) for r in f[0]] for f in found], pa.list_(run_type))
                best = pa.array([f[1] and dict(zip(names, f[1])) for f in found], run_type)
                yield pa.RecordBatch.from_arrays([part.column(0), runs, best, pa.array([f[2] for f in found], pa.binary()).cast(pa.string())], names=["doc_id", "runs", "best", "collapsed"])

    one_run = "struct<start: long, length: long, period: long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, runs array<{one_run}>, best {one_run}, collapsed string")


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's rule: in a tenth of the documents the words from some place on repeat. Rows without id stay as they are."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs and collapsed text of every document."""
    found = document_runs(table(spark, sf_dir, "documents"), planted_order)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
