"""Suffix sorting and removal of repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from memspark.llm import suffixes
from memspark.llm.queries import QUERIES
from tests.conftest import SMALL


def brute(rows, width=100):
    """(n_bytes, removed spans, kept) of each (doc_id, text) row, by all windows in order."""
    order = sorted({(i is None, i or 0, t or "") for i, t in rows})
    seen, result = set(), {}
    for no_id, i, t in order:
        text = t.encode()
        cover = np.zeros(len(text) + 1, int)
        for p in range(len(text) - width + 1):
            w = text[p : p + width]
            if w in seen:
                cover[p] += 1
                cover[p + width] -= 1
            seen.add(w)
        gone = np.cumsum(cover)[:-1] > 0
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        kept = bytes(b for b, g in zip(text, gone) if not g)
        result[no_id, i, t] = (len(text), [tuple(e) for e in edges.reshape(-1, 2).tolist()], kept)
    return [(i, *result[i is None, i or 0, t or ""]) for i, t in rows]


def digest(rows):
    return sorted(repr((i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest())) for i, n, s, k in rows)


@pytest.mark.parametrize("symbols", [1, 2, 4, 250])
def test_suffix_order_equals_sorting(symbols):
    rnd = random.Random(symbols)
    for n in [0, 1, 2, 3, 4, 5, 6, 7, 8, 20, 61, 200, 401]:
        text = [rnd.randint(1, symbols) for _ in range(n)]
        if n > 60:
            text[30:50] = text[:20]
            text[25] = 0
        order = suffixes.suffix_order(np.array(text, np.int64), 1 << 30).tolist()
        assert order == sorted(range(n), key=lambda i: text[i:]), text
        short = suffixes.suffix_order(np.array(text, np.int64), 10).tolist()
        assert sorted(short) == list(range(n))
        assert [text[i : i + 10] for i in short] == sorted(text[i : i + 10] for i in range(n))


def words(rnd, n):
    return " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda my nu xi omikron".split()) + str(rnd.randrange(90)) for _ in range(n))


def test_windows_of_parts_equal_brute_force():
    rnd = random.Random(2)
    for _ in range(30):
        passage = words(rnd, 40).encode()
        parts = [words(rnd, rnd.randint(0, 30)).encode() + passage[rnd.randint(0, 9) : rnd.randint(90, 200)] + words(rnd, 9).encode() for _ in range(6)] + [b"", b"\0" * 230, b"ab" * 80]
        seen, expected = set(), []
        for p in parts:
            at = []
            for i in range(len(p) - 99):
                if p[i : i + 100] in seen:
                    at.append(i)
                seen.add(p[i : i + 100])
            expected.append(at)
        assert [w.tolist() for w in suffixes.repeated_windows(parts)] == expected


def test_contexts_cut_all_windows_once_and_equal_windows_alike():
    rnd = random.Random(3)
    passage = words(rnd, 60).encode()
    texts = [b"", words(rnd, 50).encode() + passage, b"x" * 99, passage + words(rnd, 5).encode(), b"", b"a" * 500, b"", b"y" * 100, b""]
    owner, low, high, gram = suffixes.contexts(texts)
    windows = [(o, w) for o, a, b in zip(owner.tolist(), low.tolist(), high.tolist()) for w in range(a, b + 1)]
    assert sorted(windows) == [(o, w) for o, t in enumerate(texts) for w in range(len(t) - 99)]
    filed = {}
    for o, a, b, g in zip(owner.tolist(), low.tolist(), high.tolist(), gram.tolist()):
        for w in range(a, b + 1):
            assert filed.setdefault(texts[o][w : w + 100], g) == g


def corpus(rnd):
    passages = [words(rnd, 30) for _ in range(4)]
    texts = []
    for _ in range(60):
        parts = [words(rnd, rnd.randint(0, 25))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            parts += [p[rnd.randint(0, 30) : len(p) - rnd.randint(0, 30)], words(rnd, rnd.randint(0, 12))]
        texts.append(rnd.choice([" ", "é", "\0", ""]).join(parts))
    texts += [texts[3], texts[3] + "!", "?" + texts[5], texts[7][:400], "x" * 1000, "x" * 99, "x" * 100, "ab" * 400, None, "", "日本語のテキスト" * 40, "日本語のテキスト" * 30]
    rows = list(zip(rnd.sample(range(-500, 500), len(texts)), texts))
    return rows + [rows[2], rows[2], (rows[4][0], texts[9]), (None, texts[11]), (None, texts[12]), (None, texts[11])]


@pytest.mark.parametrize("case", ["table", "odd", "empty"])
def test_query_equals_brute_force(spark, tmp_path, case):
    if case == "table":
        where, rows = SMALL, [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    else:
        rows = [(i, t) for i, t in ODD] if case == "odd" else []
        where = str(tmp_path)
        spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, doc string").write.parquet(f"{where}/documents.parquet")
    got = QUERIES["op12_suffix_dedup"](spark, where)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    if case == "odd":  # of one doc_id the text with the smaller hash comes first, which the brute force does not know
        twice = {i for i, _ in rows if len({t for j, t in rows if j == i}) > 1}
        drop = [r for r in digest(brute(rows)) if not any(r.startswith(f"({i},") for i in twice)]
        assert sorted(repr(tuple(r)) for r in got.collect() if r["doc_id"] not in twice) == drop and len(drop) > 60
    else:
        assert sorted(repr(tuple(r)) for r in got.collect()) == digest(brute(rows))


ODD = corpus(random.Random(4))


def test_crowded_files_and_small_slices_give_the_same(spark):
    rows = [(i, t) for i, t in enumerate(t for _, t in ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    expected = digest(brute(rows))
    for file_rows, slice_bytes, sort_symbols in [(2, 600, 5000), (3, 1 << 21, 1 << 20), (8192, 1, 3000)]:
        found = suffixes.remove_repeats(docs, file_rows=file_rows, slice_bytes=slice_bytes, sort_symbols=sort_symbols).collect()
        assert digest((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], r["kept"]) for r in found) == expected
