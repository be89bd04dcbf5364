"""Periodic runs against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from memspark.llm import periodic
from memspark.llm.queries import QUERIES
from tests.conftest import SMALL


def brute_runs(words):
    """(start, length, period) by comparing words at every distance."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and (i, j + q) not in found:
                found[i, j + q] = q
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def words_with_runs(rnd):
    parts = []
    for _ in range(rnd.randint(1, 5)):
        base = [rnd.randrange(rnd.choice([1, 2, 3, 30])) for _ in range(rnd.randint(1, 9))]
        parts += base * rnd.choice([1, 1, 2, 4, 5, 9]) + base[: rnd.randrange(len(base) + 1)]
    return parts


def test_runs_of_random_words_equal_brute_force():
    rnd = random.Random(7)
    some = 0
    for _ in range(3000):
        ids = words_with_runs(rnd)
        expected = brute_runs(ids)
        some += bool(expected)
        assert [tuple(r) for r in periodic.runs_of(np.array(ids, np.int64)).tolist()] == expected, ids
    assert some > 1000
    a, b = [0], [0, 1]
    for _ in range(14):  # Fibonacci words hold many overlapping runs
        a, b = b, b + a
    assert [tuple(r) for r in periodic.runs_of(np.array(b[:900])).tolist()] == brute_runs(b[:900])


def test_the_filter_passes_every_text_with_a_run(monkeypatch):
    rnd = random.Random(8)
    for _ in range(3000):
        ids = words_with_runs(rnd)
        if brute_runs(ids):
            assert periodic.may_repeat(np.array(ids, np.int64))
    assert not periodic.may_repeat(np.arange(1000) % 400)
    monkeypatch.setattr(periodic, "ASKED", 7)
    for _ in range(200):
        ids = words_with_runs(rnd)
        assert [tuple(r) for r in periodic.runs_of(np.array(ids, np.int64)).tolist()] == brute_runs(ids)


def test_the_grammar_gives_the_words_back_and_no_pair_twice():
    rnd = random.Random(9)
    for _ in range(300):
        ids = words_with_runs(rnd)
        rules, start = periodic.repair(np.array(ids, np.int64))
        first = max(ids) + 1
        out = list(start)
        while any(s >= first for s in out):
            out = [t for s in out for t in ([s] if s < first else rules[s - first])]
        assert out == ids
        pairs = [p for i, p in enumerate(zip(start, start[1:])) if i == 0 or not start[i - 1] == start[i] == start[i + 1]]
        assert len(pairs) == len(set(pairs))


ODD = [None, "", " \n\t", "one", "a a a a a a", "a a a a a", "x\x0by\x0cz\x1cq e é é é é é é", "ha ho " * 3000, " ".join(f"w{i}" for i in range(5000)), "a b c d " * 4, "a b c d " * 4]


@pytest.mark.parametrize("case", ["table", "odd", "empty"])
def test_query_equals_brute_force(spark, tmp_path, case):
    if case == "table":
        where, rows = SMALL, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    else:
        rows = [(i * 7, t) for i, t in enumerate(ODD)] + [(None, "b " * 9), (7, "again " * 8), (7, "again " * 8)] if case == "odd" else []
        where = str(tmp_path)
        spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, runs string").write.parquet(f"{where}/documents.parquet")
    got = QUERIES["op11_periodic_runs"](spark, where)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(brute_row(*r)) for r in rows)
