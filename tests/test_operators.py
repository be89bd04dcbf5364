"""Operators against brute force on small fixtures, with cells and blocks forced to be tiny."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memspark.operators import bm25, fusion, graph, matching, running, search, versions
from memspark.operators.scope import SCOPE
from memspark.plans import consolidate

A, B = ("private", "user:a"), ("private", "user:b")


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def stop_tokens(text):
    from memspark.functions.text import STOP_WORDS

    return [w for w in text.lower().split() if len(w) > 1 and w not in STOP_WORDS]


def brute_bm25(docs, query, k, b=0.75, k1=1.5):
    toks = {i: stop_tokens(t) for i, t in docs.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / max(1, len(toks))
    score = {}
    for i, ts in toks.items():
        s = 0.0
        for w in stop_tokens(query):
            tf = ts.count(w)
            if tf:
                df = sum(w in x for x in toks.values())
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * len(ts) / avg))
        if s > 0:
            score[i] = round(s, 6)
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]


def test_a_batch_that_touches_no_posting_excludes_documents():
    import pandas as pd

    from memspark.operators import kernels

    postings = pd.DataFrame({"term": ["a"] * 9, "doc_id": list(range(9)), "tf": [1.0] * 9, "doc_len": [1.0] * 9})
    post = kernels.Postings(postings, pd.Index(["a", "b"]), ["tf"])
    q, d, score = kernels.top_documents(
        post, np.array([1]), np.array([0]), lambda rows, at: post.values["tf"][at], np.array([3]), 6, [np.array([2, 4])]
    )
    assert (len(q), len(d), len(score)) == (0, 0, 0)


WORDS = "red green blue cat dog fish tree house river stone".split()


@pytest.fixture()
def tiny_cells(monkeypatch):
    monkeypatch.setattr(bm25, "POSTINGS_PER_CELL", 40)
    monkeypatch.setattr(bm25, "TERMS_PER_CELL", 6)
    monkeypatch.setattr(search, "VECTORS_PER_CELL", 7)
    monkeypatch.setattr(search, "QUERIES_PER_CELL", 3)


def test_bm25_over_many_cells_and_scopes(spark, tiny_cells):
    rnd = random.Random(1)
    docs = {s: {i: " ".join(rnd.choices(WORDS, k=rnd.randint(1, 12))) for i in range(40)} for s in (A, B)}
    queries = {(s, q): " ".join(rnd.choices(WORDS, k=3)) for s in (A, B) for q in range(5)}
    d = frame(spark, [(*s, i, t) for s, m in docs.items() for i, t in m.items()], "scope_kind string, scope_owner string, doc_id bigint, text string")
    q = frame(spark, [(*s, n, t) for (s, n), t in queries.items()], "scope_kind string, scope_owner string, query_id bigint, text string")
    got = {}
    for r in bm25.bm25_topk(d, q, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(((r["scope_kind"], r["scope_owner"]), r["query_id"]), []).append((r["doc_id"], r["score"]))
    for (s, n), t in queries.items():
        assert got.get((s, n), []) == brute_bm25(docs[s], t, 4), (s, n)


def test_bm25_corpus_without_excluded_documents(spark, tiny_cells):
    rnd = random.Random(2)
    docs = {i: " ".join(rnd.choices(WORDS, k=8)) for i in range(30)}
    queries = {q: " ".join(rnd.choices(WORDS, k=3)) for q in range(4)}
    gone = {0: {1, 2, 3}, 1: {5}, 2: set(), 3: set(range(10))}
    d = frame(spark, [(*A, i, t) for i, t in docs.items()], "scope_kind string, scope_owner string, doc_id bigint, text string")
    q = frame(spark, [(*A, n, t) for n, t in queries.items()], "scope_kind string, scope_owner string, query_id bigint, text string")
    x = frame(spark, [(*A, n, i) for n, s in gone.items() for i in s], "scope_kind string, scope_owner string, query_id bigint, doc_id bigint")
    got = {}
    for r in bm25.bm25_topk(d, q, k=5, exclude=x).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    for n, t in queries.items():
        assert got[n] == brute_bm25({i: v for i, v in docs.items() if i not in gone[n]}, t, 5)


def test_repeated_query_terms_count_again(spark):
    d = frame(spark, [(*A, 1, "cat"), (*A, 2, "dog")], "scope_kind string, scope_owner string, doc_id bigint, text string")
    q = frame(spark, [(*A, 1, "cat"), (*A, 2, "cat cat")], "scope_kind string, scope_owner string, query_id bigint, text string")
    s = {r["query_id"]: r["score"] for r in bm25.bm25_topk(d, q).collect()}
    assert s[2] == pytest.approx(2 * s[1], abs=2e-6)


def vectors(n, dims, seed):
    return np.random.default_rng(seed).standard_normal((n, dims)).astype(np.float32)


def cos(a, b):
    a, b = a.astype(np.float64), b.astype(np.float64)
    return round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), 6)


def test_vector_topk_over_many_cells(spark, tiny_cells):
    v, q = vectors(60, 8, 1), vectors(9, 8, 2)
    vdf = frame(spark, [(*(A if i % 3 else B), i, v[i].tolist()) for i in range(60)], "scope_kind string, scope_owner string, id bigint, vector array<float>")
    qdf = frame(spark, [(*A, i, q[i].tolist()) for i in range(9)], "scope_kind string, scope_owner string, query_id bigint, query_vector array<float>")
    got = {}
    for r in search.vector_topk(vdf, qdf, k=6, threshold=0.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["sim"]))
    for n in range(9):
        want = sorted(((i, cos(v[i], q[n])) for i in range(60) if i % 3), key=lambda x: (-x[1], x[0]))
        assert got[n] == [w for w in want if w[1] >= 0][:6]


def test_group_spread_over_cells_keeps_its_best_vector(spark, tiny_cells):
    v, q = vectors(50, 6, 3), vectors(4, 6, 4)
    f = frame(spark, [(*A, f"s{i % 5}", v[i].tolist()) for i in range(50)], "scope_kind string, scope_owner string, summary_id string, vector array<float>")
    qdf = frame(spark, [(*A, i, q[i].tolist()) for i in range(4)], "scope_kind string, scope_owner string, query_id bigint, query_vector array<float>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["sim"]) for r in search.fact_channel(f, qdf, k=2).collect()}
    for n in range(4):
        want = sorted(((f"s{g}", max(cos(v[i], q[n]) for i in range(50) if i % 5 == g)) for g in range(5)), key=lambda x: (-x[1], x[0]))
        assert [got[(n, 0)], got[(n, 1)]] == want[:2]


def test_pruned_search_is_exact(spark):
    v = vectors(300, 16, 5)
    v[:150] *= 0.02
    v[:150] += vectors(1, 16, 6)[0]  # one tight crowd beside scattered vectors
    vdf = frame(spark, [(*A, i, v[i].tolist()) for i in range(300)], "scope_kind string, scope_owner string, id bigint, vector array<float>")
    qdf = vdf.select(*SCOPE, F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("id").alias("self_id"))
    exact = search.vector_topk(vdf, qdf, k=5, exclude_self=True).select("query_id", "id", "rank", "sim")
    near = search.vector_topk_pruned(vdf, qdf, k=5, anchors=12, exclude_self=True).select("query_id", "id", "rank", "sim")
    assert sorted(exact.collect()) == sorted(near.collect())


def test_mmr_prefers_variety(spark):
    rows = [(*A, 1, "a", 1.0, ["x", "y", "z"]), (*A, 1, "b", 0.95, ["x", "y", "z"]), (*A, 1, "c", 0.8, ["p", "q"]), (*A, 2, "m", 0.1, ["x"]), (*A, 2, "n", 0.2, ["x"])]
    pool = frame(spark, rows, "scope_kind string, scope_owner string, query_id int, id string, relevance double, tokens array<string>")
    got = [(r["query_id"], r["id"]) for r in fusion.mmr_select(pool, k=2).orderBy("query_id", "pick").collect()]
    assert got == [(1, "a"), (1, "c"), (2, "n"), (2, "m")]
    only = [r["id"] for r in fusion.mmr_select(pool.filter("query_id = 1"), k=2, lam=1.0).orderBy("pick").collect()]
    assert only == ["a", "b"]


def test_names_in_texts_equal_contains(spark):
    rnd = random.Random(2)
    pick = lambda n: "".join(rnd.choice("ab é\n") for _ in range(n))
    texts = [(*s, i, pick(rnd.randint(0, 40))) for s in (A, B) for i in range(40)] + [(*A, 97, None), (*A, 98, ""), (*A, 99, "x" * 5000 + " one  two")]
    names = [(*s, f"n{i}", pick(rnd.randint(0, 6))) for s in (A, B) for i in range(40)] + [(*A, "deep", "xe"), (*A, "two", "e  t"), (*A, "gap", "  "), (*A, "gone", "zq"), (*A, "null", None)]
    t = frame(spark, texts, "scope_kind string, scope_owner string, text_id int, text string")
    n = frame(spark, names, "scope_kind string, scope_owner string, name_id string, name string")
    rows = [(r["scope_owner"], r["text_id"], r["name_id"]) for r in matching.names_in_texts(t, n).collect()]
    expected = {(ts[1], ts[2], ns[2]) for ts in texts for ns in names if ts[:2] == ns[:2] and ts[3] and ns[3] and ns[3] in ts[3]}
    assert len(rows) == len(set(rows)) and set(rows) == expected and len(expected) > 300


def test_stage1_respects_scope_slug_and_self_model(spark):
    e = frame(spark, [(*A, "project:meridian", "project", "Meridian X", dt.date(2024, 1, 30)), (*B, "project:meridian", "project", "Meridian", dt.date(2024, 1, 1)), (*A, "self", "self_model", "plan", dt.date(2024, 1, 1))],
              "scope_kind string, scope_owner string, id string, kind string, name string, last_updated date")
    q = frame(spark, [(*A, 1, "The MERIDIAN plan"), (*A, 2, "meridian last year"), (*B, 3, "nope")], "scope_kind string, scope_owner string, query_id int, text string")
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    got = {(r["query_id"], r["scope_owner"], r["id"]) for r in matching.stage1_entity_match(q, e, now).collect()}
    assert got == {(1, "user:a", "project:meridian")}


def test_components_match_brute_force(spark):
    v = vectors(80, 3, 7)
    rows = frame(spark, [(*(A if i % 2 else B), dt.date(2024, 1, 1), i, v[i].tolist()) for i in range(80)], "scope_kind string, scope_owner string, day date, id bigint, vector array<float>")
    keys = [*SCOPE, "day"]
    edges = graph.similarity_edges(rows, keys, sim=0.9, block=9)
    got = {r["id"]: r["label"] for r in graph.components(rows.select(*keys, "id"), edges, keys).collect()}
    want = {i: i for i in range(80)}
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(80), 2):
            if i % 2 == j % 2 and cos(v[i], v[j]) >= 0.9 and want[i] != want[j]:
                want[i] = want[j] = min(want[i], want[j])
                changed = True
    assert got == want


def test_clusters_meet_only_where_they_can_be_alike(spark):
    """Large groups against brute force; places that are too far apart are never looked at."""
    rnd = np.random.default_rng(4)
    middles = rnd.standard_normal((12, 16))
    v = {f"a{i:03d}": (middles[i % 12] + rnd.standard_normal(16) * 0.12) for i in range(300)} | {"zero": np.zeros(16), "zero2": np.zeros(16)} | {f"s{i}": rnd.standard_normal(3) for i in range(30)}
    day = dt.date(2024, 1, 1)
    rows = frame(spark, [(*A, day, i, [float(c) for c in np.float32(x)]) for i, x in v.items()], "scope_kind string, scope_owner string, day date, id string, vector array<float>")
    got = {r["id"]: r["cluster"] for r in graph.topic_clusters(rows, min_sources=1, sim=0.9, block=20).collect()}
    want = {i: i for i in v}
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(v, 2):
            if len(v[i]) == len(v[j]) and v[i].any() and v[j].any() and round(cos_exact(np.float32(v[i]), np.float32(v[j])), 6) >= 0.9 and want[i] != want[j]:
                want[i] = want[j] = min(want[i], want[j])
                changed = True
    assert got == want
    placed, cells = graph.similarity_cells(rows, [*SCOPE, "day"], sim=0.9, block=20)
    places, met = placed.filter("size(vector) = 16").select("place").distinct().count(), cells.filter("left._d = 16").count()
    assert met < 0.6 * places * (places + 1) / 2


def test_components_of_a_long_chain(spark):
    n = 200
    nodes = frame(spark, [(*A, i) for i in range(n)], "scope_kind string, scope_owner string, id bigint")
    edges = frame(spark, [(*A, i, i + 1) for i in range(n - 1)], "scope_kind string, scope_owner string, src bigint, dst bigint")
    assert {r["label"] for r in graph.components(nodes, edges, SCOPE).collect()} == {0}


def brute_cap(centroids, cap):
    names, m = sorted(centroids), [np.asarray(centroids[k], dtype=np.float32) for k in sorted(centroids)]
    members = [[k] for k in names]
    while len(m) > cap:
        pairs = [(-cos_exact(m[i], m[j]), i, j) for i in range(len(m)) for j in range(i + 1, len(m))]
        _, i, j = min(pairs)
        members[i] += members[j]
        m[i] = (m[i] + m[j]) / np.float32(2)
        del members[j], m[j]
    return {k: g[0] for g in members for k in g}


def cos_exact(a, b):
    a, b = a.astype(np.float64), b.astype(np.float64)
    return float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_cluster_cap_matches_brute_force(spark):
    v = vectors(25, 5, 11)
    src = frame(spark, [(*A, dt.date(2024, 1, 1), f"e{i:02d}", v[i].tolist()) for i in range(25)], "scope_kind string, scope_owner string, day date, id string, vector array<float>")
    clusters = src.select(*SCOPE, "day", "id", F.col("id").alias("cluster"))
    got = {r["id"]: r["cluster"] for r in graph.cluster_cap(src, clusters, dimensions=5, cap=6).collect()}
    assert got == brute_cap({f"e{i:02d}": v[i] for i in range(25)}, 6)


def test_graph_walk_is_bounded_and_scoped(spark):
    edges = [(*A, "a", "b", None), (*A, "b", "c", None), (*A, "c", "d", None), (*A, "a", "x", dt.date(2024, 1, 1)), (*B, "a", "z", None)] + [(*A, "b", f"n{i:02d}", None) for i in range(40)]
    e = frame(spark, edges, "scope_kind string, scope_owner string, subject_id string, object_id string, valid_until date")
    s = frame(spark, [(*A, 1, "a")], "scope_kind string, scope_owner string, query_id int, id string")
    got = [(r["hop"], r["id"]) for r in graph.graph_walk(e, s).orderBy("hop", "id").collect()]
    assert got == [(1, "b"), (2, "c")] + [(2, f"n{i:02d}") for i in range(8)]


@pytest.mark.parametrize("many_seeds", [0, 3, 100])
def test_graph_walk_with_many_seeds_equals_brute_force(spark, many_seeds):
    rnd = random.Random(6)
    pairs = {(f"n{rnd.randrange(25):02d}", f"n{rnd.randrange(60):02d}") for _ in range(140)} | {("n00", f"n{i:02d}") for i in range(1, 60)}
    e = frame(spark, [(*A, a, b, None) for a, b in pairs], "scope_kind string, scope_owner string, subject_id string, object_id string, valid_until date")
    asked = {q: set(rnd.sample([f"n{i:02d}" for i in range(60)], n)) for q, n in enumerate([1, 2, 3, 5, 30, 60])}
    s = frame(spark, [(*A, q, i) for q, ids in asked.items() for i in ids], "scope_kind string, scope_owner string, query_id int, id string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    expected = set()
    for q, ids in asked.items():
        seen, front, found = set(ids), ids, []
        for hop in (1, 2):
            front = sorted({y for x in front for y in near.get(x, ())} - seen)[:4]
            found += [(hop, i) for i in front]
            seen |= set(front)
        expected |= {(q, h, i) for h, i in found[:4]}
    got = {(r["query_id"], r["hop"], r["id"]) for r in graph.graph_walk(e, s, max_results=4, many_seeds=many_seeds).collect()}
    assert got == expected


def test_positions_cross_buckets(spark):
    rnd = random.Random(3)
    rows = [("k" if rnd.random() < 0.8 else "j", rnd.randint(0, 9), i, rnd.randint(1, 5)) for i in range(200)]
    df = frame(spark, rows, "key string, b int, id int, v int")
    out = running.running_totals(df, ["key"], F.col("b"), [F.col("id")], F.col("v"), "before", "pos").collect()
    for key in "kj":
        total, pos = 0, 0
        mine = {r["id"]: (r["before"], r["pos"]) for r in out if r["key"] == key}
        for _, _, i, v in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            pos += 1
            assert mine[i] == (total, pos)
            total += v


def test_version_order_survives_cycles_and_gaps(spark):
    rows = [(*A, "p", "v1", None), (*A, "p", "v2", "v1"), (*A, "p", "v3", "v2"), (*A, "p", "lost", "gone"), (*A, "p", "c1", "c2"), (*A, "p", "c2", "c1"), (*B, "p", "v2", "v1")]
    df = frame(spark, rows, "scope_kind string, scope_owner string, period string, id string, supersedes string")
    out = versions.version_chain_order(df, [*SCOPE, "period"]).collect()
    depth = {(r["scope_owner"], r["id"]): r["depth"] for r in out}
    assert len(out) == 7 and depth[("user:a", "v3")] == 2 and depth[("user:a", "lost")] == 0 and depth[("user:b", "v2")] == 0
    assert depth[("user:a", "c1")] == depth[("user:a", "c2")] == -1


def brute_edges(old, new):
    rows = [list(r) for r in old]
    for o, f, u in new:
        if any(r == [o, f, u] for r in rows) or (f is None and u is None and any(r[0] == o for r in rows)):
            continue
        if f is not None:
            for r in rows:
                if r[0] != o and r[2] is None and (r[1] is None or r[1] <= f):
                    r[2] = f
        rows.append([o, f, u])
    return sorted(map(str, rows))


@pytest.mark.parametrize(("seed", "bucket_rows"), [(0, 200_000), (1, 200_000), (2, 3), (3, 1), (4, 7)])
def test_relationships_in_any_arrival_order(spark, seed, bucket_rows):
    rnd = random.Random(seed)
    day = lambda: rnd.choice([None] + [dt.date(2024, 1, d) for d in range(1, 6)])

    def edge():
        f, u = day(), None
        if rnd.random() < 0.2:
            u = dt.date(2024, 1, rnd.randint(6, 9))
        return rnd.choice("xyz"), f, u

    old = [edge() for _ in range(3)]
    new = [edge() for _ in range(25)]
    ddl = "scope_kind string, scope_owner string, subject_id string, predicate string, object_id string, valid_from date, valid_until date"
    old_df = frame(spark, [(*A, "s", "p", *r) for r in old], ddl)
    rows = [(*s, "s", "p", *r, i) for s in (A, B) for i, r in enumerate(new)] + [(*A, "s", "p", "ghost", None, None, 99)]
    new_df = frame(spark, rows, ddl + ", arrival bigint")
    ents = frame(spark, [(*s, i) for s in (A, B) for i in ("s", "x", "y", "z")], "scope_kind string, scope_owner string, id string")
    out = versions.relationship_upsert(old_df, new_df, ents, bucket_rows).collect()
    for scope, start in ((A, old), (B, [])):
        got = sorted(str([r["object_id"], r["valid_from"], r["valid_until"]]) for r in out if r["scope_owner"] == scope[1])
        assert got == brute_edges(start, new)


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_of_a_key_with_a_bucket_per_row(spark, descending):
    """Levels of totals, each small: nothing is summed up by one window over the key."""
    rnd = random.Random(5)
    rows = [("hot", i, rnd.randrange(9)) for i in rnd.sample(range(10_000), 400)] + [(f"k{i % 7}", i, i % 3) for i in range(40)]
    df = frame(spark, rows, "key string, id bigint, v bigint")
    order = F.col("id").desc() if descending else F.col("id").asc()
    out = running.running_totals(df, ["key"], F.col("id"), [order], F.col("v"), "before", "pos", descending, level_rows=6).collect()
    expected = {}
    for key in {r[0] for r in rows}:
        before = 0
        for pos, (_, i, v) in enumerate(sorted((r for r in rows if r[0] == key), reverse=descending), 1):
            expected[key, i] = (before, pos)
            before += v
    assert {(r["key"], r["id"]): (r["before"], r["pos"]) for r in out} == expected
    alone = running.running_totals(df.filter("key = 'hot'").drop("key"), [], F.col("id"), [F.col("id").asc()], F.col("v"), "before", level_rows=50)
    assert alone.agg(F.max("before")).first()[0] == sum(r[2] for r in rows if r[0] == "hot") - max((r for r in rows if r[0] == "hot"))[2]


def test_rollup_calendar(spark):
    dates = frame(spark, [(dt.date(2024, 1, 1),), (dt.date(2024, 3, 1),), (dt.date(2024, 3, 5),)], "date date")
    jobs = {(str(r["date"]), r["level"]): (r["period"], r["source_periods"]) for r in consolidate.due_rollups(dates).collect()}
    assert set(jobs) == {("2024-01-01", "weekly"), ("2024-01-01", "monthly"), ("2024-01-01", "yearly"), ("2024-03-01", "monthly")}
    assert jobs[("2024-01-01", "weekly")] == ("2023-W52", [f"2023-12-{d}" for d in range(25, 32)])
    assert jobs[("2024-03-01", "monthly")] == ("2024-02", ["2024-W06", "2024-W07", "2024-W08", "2024-W09"])
    assert jobs[("2024-01-01", "yearly")][1][0] == "2023-01" and len(jobs[("2024-01-01", "yearly")][1]) == 12


def test_contradictions_take_equal_facts_in_turn(spark):
    f = frame(spark, [(*A, "s", 1, "x", 1), (*A, "s", 2, "x", 1), (*A, "s", 3, "y", 0)], "scope_kind string, scope_owner string, summary_id string, id bigint, fact string, source_count int")
    v = frame(spark, [(*A, "s", 1, "x", "z", "changed"), (*A, "s", 2, "x", "", "changed"), (*A, "s", 3, "y", None, "redundant"), (*A, "s", 4, "nope", "q", "changed"), (*B, "s", 5, "y", "q", "changed")],
              "scope_kind string, scope_owner string, summary_id string, ord int, old_fact string, replacement string, reason string")
    got = {r["id"]: (r["fact"], r["source_count"], r["outcome"]) for r in consolidate.contradiction_apply(f, v).collect()}
    assert got == {1: ("z", 1, "replaced"), 2: ("x", 1, "removed"), 3: ("y", 2, "reinforced")}


def test_specificity_equals_brute_force_with_hubs(spark):
    rnd = random.Random(9)
    docs = [(f"d{i:03d}", rnd.choices([f"e{k}" for k in range(30)], k=rnd.randint(0, 3)) + ["hub"] * (i % 10 > 0) + ["hub2"] * (i % 7 > 2), i % 11) for i in range(200)]
    s = frame(spark, [(*A, i, e, None, dt.datetime(2024, 1, 1 + d)) for i, e, d in docs], "scope_kind string, scope_owner string, id string, entities_touched array<string>, supersedes string, created_at timestamp_ntz")
    trig = frame(spark, [(*A, i, e) for i, e, _ in docs[::3]] + [(*A, "q1", ["hub"]), (*A, "q2", ["hub", "hub2"]), (*A, "q3", ["nope"])], "scope_kind string, scope_owner string, id string, entities_touched array<string>")
    freq = {}
    for _, e, _ in docs:
        for x in e:
            freq[x] = freq.get(x, 0) + 1
    expected = set()
    for q, wanted in [(i, e) for i, e, _ in docs[::3]] + [("q1", ["hub"]), ("q2", ["hub", "hub2"])]:
        rows = [(-round(sum(1 / freq[x] for x in e if x in wanted), 9), -d, i) for i, e, d in docs if i != q and set(e) & set(wanted)]
        expected |= {(q, r[2], n) for n, r in enumerate(sorted(rows)[:5], 1)}
    for hub_rows in (4096, 20, 0):
        got = {(r["query_id"], r["doc_id"], r["rank"]) for r in consolidate.entity_specificity(s, trig, hub_rows=hub_rows).collect()}
        assert got == expected


def test_specificity_prefers_rare_entities(spark):
    s = frame(spark, [(*A, "new", ["hub", "rare"], None), (*A, "r", ["rare"], None), (*A, "h1", ["hub"], None), (*A, "h2", ["hub"], None), (*B, "o", ["rare"], None), (*A, "old", ["rare"], None), (*A, "now", ["zip"], "old")],
              "scope_kind string, scope_owner string, id string, entities_touched array<string>, supersedes string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = [r["doc_id"] for r in consolidate.entity_specificity(s, s.filter("id = 'new'")).orderBy("rank").collect()]
    assert got == ["r", "h1", "h2"]


def test_entity_lookup_tiers(spark):
    e = frame(spark, [(*A, "place:rome", "place", "Rome", dt.date(2024, 1, 2)), (*A, "place:romeo", "person", "Romeo", dt.date(2024, 1, 3)), (*A, "place:a_b", "place", "A_B", dt.date(2024, 1, 1)), (*B, "place:rome", "place", "Rome", dt.date(2024, 1, 1))],
              "scope_kind string, scope_owner string, id string, kind string, name string, last_updated date")
    q = frame(spark, [(*A, 1, " place:rome "), (*A, 2, "ROME"), (*A, 3, "rom"), (*A, 4, "_"), (*A, 5, "  "), (*A, 6, "%")], "scope_kind string, scope_owner string, lookup_id int, wanted string")
    got = {}
    for r in matching.entity_lookup(e, q).orderBy("lookup_id", "rank").collect():
        got.setdefault(r["lookup_id"], []).append((r["tier"], r["id"]))
    assert got == {1: [(1, "place:rome")], 2: [(2, "place:rome")], 3: [(3, "place:romeo"), (3, "place:rome")], 4: [(3, "place:a_b")]}
