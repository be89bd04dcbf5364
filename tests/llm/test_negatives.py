"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest

from memspark.llm import hardneg
from memspark.llm.queries import QUERIES

NAN, INF = float("nan"), float("inf")


def brute(rows):
    """(anchor, positive, rank, negative, positive score, negative score) by the definition, in Python integers."""
    good = []
    for vec_id, x, label in rows:
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) or abs(256 * v) >= (1 << 27) - 1 for v in x):
            continue
        good.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(v))) for v in x]))
    out, anchors = [], {}
    for vec_id, label, x in good:
        if vec_id % 100 == 0:
            key = (len(x), vec_id)
            if key not in anchors or label < anchors[key][0]:
                anchors[key] = (label, x)
    for (d, a), (label, x) in anchors.items():
        scored = [(-sum(p * q for p, q in zip(x, y)), v, c == label) for v, c, y in good if v != a and len(y) == d]
        for ps, p, _ in sorted(s for s in scored if s[2])[:5]:
            fits = sorted((ns, n) for ns, n, same in scored if not same and -80 * ps <= -100 * ns <= -100 * ps)[:5]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n) in enumerate(fits, 1)]
    return sorted(out)


def embeddings(spark, path, rows):
    rows = [(*r, "clash", 1.0) for r in rows]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string, score double").write.parquet(f"{path}/embeddings.parquet")


def mined(spark, path):
    return sorted(tuple(r) for r in QUERIES["op13_hard_negatives"](spark, str(path)).collect())


@pytest.mark.parametrize("d", [3, 64, 70])
def test_mined_negatives_equal_brute_force(spark, tmp_path, d):
    rnd = np.random.default_rng(d)
    middles = rnd.standard_normal((6, d))
    rows = []
    for i in range(0, 700):
        x = middles[rnd.integers(6)] + rnd.standard_normal(d) * (0.4 if d > 3 else 0.1)
        rows.append((i, [float(v) for v in np.float32(x)], int(rnd.integers(3))))
    rows += [(1000 + i, rows[7][1], i % 4) for i in range(12)]  # ties
    rows += [(None, rows[0][1], 1), (2001, None, 1), (2002, rows[1][1], None), (2003, [NAN] * d, 1), (2004, [None] * d, 1), (2005, [INF] * d, 2), (2006, [0.0] * d, 1), (2007, [1e9] * d, 1)]
    embeddings(spark, tmp_path, rows)
    got = mined(spark, tmp_path)
    assert got == brute(rows) and len(got) > 50


def test_small_and_odd_tables(spark, tmp_path):
    embeddings(spark, tmp_path / "none", [])
    assert mined(spark, tmp_path / "none") == []
    odd = [(0, [], 1), (1, [], 2), (2, [], 1), (100, [0.0, 0.0], 1), (101, [0.0, 0.0], 1), (102, [0.0, 0.0], 2), (103, [1.0, 2.0, 3.0], 1), (200, [1.0], 3), (201, [1.0], 3), (202, [0.9], 1), (203, [-1.0], 1)]
    embeddings(spark, tmp_path / "odd", odd)
    assert mined(spark, tmp_path / "odd") == brute(odd)
    twice = [(200, [2.0, 1.0], 3), (200, [2.0, 1.0], 3), (5, [2.0, 1.0], 3), (5, [2.0, 1.0], 3), (6, [1.9, 1.0], 1), (6, [1.9, 1.0], 1)]
    embeddings(spark, tmp_path / "twice", twice)
    assert {r[:2] for r in mined(spark, tmp_path / "twice")} == {(200, 5)}


def test_many_passes_give_the_same(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i * 50, [rnd.gauss(0, 1) for _ in range(16)], rnd.randrange(3)) for i in range(300)]
    embeddings(spark, tmp_path, rows)
    source = hardneg.scaled_rows(spark.read.parquet(f"{tmp_path}/embeddings.parquet")).selectExpr("vec_id", "label", "vec_id % 100 = 0 AS anchor", "x")
    whole = sorted(tuple(r) for r in hardneg.mine_hard_negatives(source).collect())
    assert whole == sorted(tuple(r) for r in hardneg.mine_hard_negatives(source, block_bytes=16 * 8 * 40).collect()) and whole


def test_intervals_hold_every_score():
    rnd = np.random.default_rng(1)
    for d in (1, 5, 64, 130):
        turn = hardneg.rotation(d)
        ints = rnd.integers(-300, 300, (400, d)) * rnd.integers(0, 2, (400, 1))
        ints[1::3] = ints[0] + rnd.integers(-9, 9, (len(ints[1::3]), d))
        code, norm, align = hardneg.encode(ints, turn)
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        for q in (ints[0], ints[5], ints[7]):
            anchor = hardneg.Anchor(q, turn)
            least, most = anchor.interval(code, ones, norm, align)
            true = ints @ q
            assert (least <= true).all() and (true <= most).all()
            if d > 4 and q.any():
                assert (most - least).mean() < 1.7 * (norm * anchor.norm).mean()  # they say something
