"""Batch retrieval against a plain restatement on a small memory of two scopes."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from memspark.functions.vectors import hash_embed
from memspark.operators.scope import SCOPE
from memspark.plans import retrieve
from tests.test_operators import A, B, brute_bm25, cos, stop_tokens

DIM, MODEL = 32, "m"
NOW = "2024-01-31 12:00:00"
SUMMARIES = {
    "s01": ("2024-01-22", "nate won the chess tournament and met joanna for dinner"),
    "s02": ("2024-01-23", "nate entered another chess tournament in the old town"),
    "s03": ("2024-01-24", "the meridian scheduler moved from redis storage onto postgres tables"),
    "s04": ("2024-01-29", "joanna painted a river and a stone house"),
    "s05": ("2024-01-30", "nate practised chess openings with a friend all day"),
    "s06": ("2023-12-11", "a long walk by the river with the dog"),
    "s07": ("2024-01-25", "nate won chess tournament prize money again"),
    "s08": ("soon", "chess club dues were paid by nate"),
}
FACTS = {1: ("s01", "Nate won the chess tournament"), 2: ("s02", "Nate entered a chess tournament"), 3: ("s07", "Nate won the chess tournament"), 4: ("s03", "Meridian uses postgres"),
         5: ("s07", "Nate kept the prize"), 6: ("s07", "the prize was money"), 7: ("s07", "a quiet evening"), 8: ("s04", "not grounded")}
QUERIES = {
    1: "How many chess tournaments has Nate won?", 2: "what did meridian use last week", 3: "zzqx plorf wibben", 4: "chess tournament nate won prize", 5: "Which came first chess or river?",
    6: "what about joanna last year", 7: "",
}


def embed_one(text):
    return np.asarray(hash_embed(DIM).func(pd.Series([text]))[0])


@pytest.fixture(scope="module")
def tables(spark):
    def df(rows, ddl):
        return spark.createDataFrame(rows, ddl)

    def vec(d, c):
        return d.withColumn("embedding", hash_embed(DIM)(F.col(c))).withColumn("embedding_model", F.lit(MODEL))

    s = [(*A, i, "daily", p, t, ["person:nate"] if "nate" in t else [], None) for i, (p, t) in SUMMARIES.items()]
    s += [(*A, "s00", "daily", "2024-01-22", "old words about nate", [], None), (*B, "b01", "daily", "2024-01-22", "nate won the chess tournament", [], None)]
    s = [r if r[2] != "s01" else (*r[:7], "s00") for r in s]
    summaries = df(s, "scope_kind string, scope_owner string, id string, level string, period string, summary string, entities_touched array<string>, supersedes string")
    summaries = vec(summaries, "summary").withColumn("created_at", F.lit(NOW).cast("timestamp_ntz"))
    f = [(*A, i, sid, t, i != 8, None, 1 + i % 2, False) for i, (sid, t) in FACTS.items()]
    facts = vec(df(f, "scope_kind string, scope_owner string, id bigint, summary_id string, fact string, grounded boolean, expires_at date, source_count int, is_inference boolean"), "fact")
    e = [(*A, "person:nate", "person", "Nate", dt.date(2024, 1, 25)), (*A, "project:meridian", "project", "Meridian", dt.date(2024, 1, 24)), (*A, "person:joanna", "person", "Joanna", dt.date(2024, 1, 29)),
         (*A, "me", "self_model", "me", dt.date(2024, 1, 1)), (*B, "person:nate", "person", "Nate", dt.date(2024, 1, 25))]
    entities = vec(df(e, "scope_kind string, scope_owner string, id string, kind string, name string, last_updated date"), "name")
    m = [(*A, "m1", "person:nate", "game", "chess", True, True, None), (*A, "m2", "person:nate", "city", "old", True, True, None), (*A, "m3", "person:nate", "city", "Oslo <1>", True, True, "m2"),
         (*A, "m4", "me", "name", "Ann", True, True, None), (*A, "m5", "project:meridian", "db", "", True, False, None)]
    memories = df(m, "scope_kind string, scope_owner string, id string, entity_id string, attribute_key string, content string, is_static boolean, grounded boolean, supersedes string")
    ep = [(*A, "e1", "interaction", dt.datetime(2024, 1, 23), "who won the chess tournament", "nate won it"), (*A, "e2", "interaction", dt.datetime(2024, 1, 30), "tell me of the river", "it is long"), (*A, "e3", "note", dt.datetime(2024, 1, 30), "chess", "chess")]
    episodes = vec(df(ep, "scope_kind string, scope_owner string, id string, type string, ts timestamp_ntz, input_text string, output_text string").withColumn("x", F.concat("input_text", F.lit(" "), "output_text")), "x")
    r = [(*A, "person:nate", "knows", "person:joanna", None)]
    rel = df(r, "scope_kind string, scope_owner string, subject_id string, predicate string, object_id string, valid_until date")
    rels = df([(*A, "mem_fact_3", "mem_fact_1", "updates")], "scope_kind string, scope_owner string, from_memory_id string, to_memory_id string, relation_type string")
    return retrieve.MemoryTables(episodes, summaries, facts, entities, memories, rel, rels, MODEL)


@pytest.fixture(scope="module")
def found(spark, tables):
    q = spark.createDataFrame([(n, *A, *A, t) for n, t in QUERIES.items()], "query_id int, acting_kind string, acting_owner string, scope_kind string, scope_owner string, text string")
    s = retrieve.retrieve_batch(q, tables, as_of=F.lit(NOW).cast("timestamp_ntz"), embed=hash_embed(DIM), options=retrieve.Options(graph=True))
    return s, {r["query_id"]: r for r in s.context().collect()}


def brute_picks(text, frame, wide):
    k, thr = (15, 0.25) if wide else (5, 0.40)
    q = embed_one(text)

    def ranked(items):
        return {i: r for r, (i, _) in enumerate(sorted(items, key=lambda x: (-x[1], x[0]))[: k * 3])}

    def sims(rows):
        out = {}
        for i, t in rows:
            v = embed_one(t)
            s = cos(v, q) if v.any() and q.any() else 0.0
            out[i] = max(out.get(i, -1), s)
        return [(i, s) for i, s in out.items() if s >= thr]

    vec = ranked(sims([(i, t) for i, (_, t) in SUMMARIES.items()]))
    fact = ranked(sims([(s, t) for n, (s, t) in FACTS.items() if n != 8]))
    kw = {i: r for r, (i, _) in enumerate(brute_bm25({i: t for i, (_, t) in SUMMARIES.items()}, text.replace("?", " "), k * 3))}
    ids = sorted({*vec, *fact, *kw})
    rel = {i: sum(1 / (c[i] + 2) for c in (vec, kw, fact) if i in c) for i in ids}
    if frame:
        def inside(i):
            try:
                return frame[0] <= dt.date.fromisoformat(SUMMARIES[i][0]) < frame[1]
            except ValueError:
                return None

        kept = [i for i in ids if inside(i) is not False]
        ids = kept or ids
        rel = {i: rel[i] + (0.5 if inside(i) else 0) for i in ids}
    if k >= len(ids):
        return sorted(ids, key=lambda i: (-rel[i], i))
    toks = {i: set(stop_tokens(SUMMARIES[i][1])) for i in ids}
    picked = []
    while len(picked) < k:
        def gain(i):
            near = max((len(toks[i] & toks[p]) / len(toks[i] | toks[p]) for p in picked), default=0)
            return 0.7 * rel[i] - (1 - 0.7) * near

        picked.append(max((i for i in ids if i not in picked), key=lambda i: (gain(i), [-ord(c) for c in i])))
    return picked


LAST_WEEK, LAST_YEAR = (dt.date(2024, 1, 22), dt.date(2024, 1, 29)), (dt.date(2023, 1, 1), dt.date(2024, 1, 1))


def test_picks(found):
    s, _ = found
    got = {}
    for r in s.picks.orderBy("query_id", "pick").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    for n, frame, wide in ((1, None, False), (2, LAST_WEEK, False), (4, None, False), (5, None, True), (6, LAST_YEAR, False)):
        assert got.get(n, []) == brute_picks(QUERIES[n], frame, wide), n
    assert 3 not in got and 7 not in got


def test_gates_and_anchor(found):
    _, rows = found
    assert [rows[n]["gate"] for n in range(1, 8)] == ["full", "full", "skipped", "full", "full", rows[6]["gate"], "skipped"]
    assert rows[3]["context"] == 'self_model: {"name":"Ann"}\n(latest daily summary: soon)\n' == rows[7]["context"]
    assert all(r["context"].startswith("self_model: ") for r in rows.values())


def test_counting_block_lists_each_text_once(found):
    _, rows = found
    c = rows[1]["context"]
    assert "Every recorded occurrence found for Nate (3 total, deduplicated):\n1. 2024-01-22: Nate won the chess tournament\n2. 2024-01-23: Nate entered a chess tournament\n3. 2024-01-25: Nate kept the prize" in c
    assert rows[1]["needs_aggregation"] and rows[5]["needs_aggregation"] and not rows[4]["needs_aggregation"]


def test_entity_line_uses_current_attributes(found):
    _, rows = found
    line = 'entity person:nate, last updated 2024-01-25 (6 days before now) (Nate): {"city":"Oslo \\u003c1\\u003e","game":"chess"}'
    assert line in rows[1]["context"]
    assert "entity project:meridian, last updated 2024-01-24 (1 week before now) (Meridian): null" in rows[2]["context"]


def test_timeframe_drops_entities_but_backs_off_for_the_rest(found):
    s, _ = found
    assert [r["id"] for r in s.matched.filter("query_id = 6").collect()] == []
    assert [r["id"] for r in s.picks.filter("query_id = 6").collect()] == ["s04", "s01"]  # no summary lies in the year, so all hits stay: both name the asker's words


def test_citations_carry_relations_and_parents(found):
    s, _ = found
    rows = [r for r in s.citations().filter("query_id = 4").collect()]
    fact = [r for r in rows if r["ref_id"] == "mem_fact_3" and r["section"] == 4][0]
    assert fact["parent_summary_id"] == "s07" and [(x["relation_type"], x["id"]) for x in fact["relations"]] == [("updates", "mem_fact_1")]
    assert not any(r["ref_id"] in ("mem_fact_8", "b01", "s00") for r in rows)
    assert {r["ref_id"] for r in rows if r["section"] == 2} == {"person:nate", "m1", "m3"}


def test_graph_reaches_neighbours(found):
    s, _ = found
    w = {(r["query_id"], r["id"]) for r in s.walked.collect()}
    hit = {(r["query_id"], r["id"]) for d in (s.entities, s.keyword_entities, s.matched) for r in d.collect()}
    assert all((n, "person:joanna") in w | hit for n in (1, 4)) and not (w & hit)


def test_context_fits_the_budget(found):
    _, rows = found
    for r in rows.values():
        assert len(r["context"]) <= 2000 + len("\n...[truncated to fit context budget]")


def test_selfcheck(spark, tables):
    p = spark.createDataFrame(
        [("a", *A, "who is Nate?", "full", None, "chess"), ("b", *A, "zz plorf", None, "skipped", None), ("c", *A, "who is Nate?", None, "partial", "absent"), ("d", "shared", "team:x", "what now", None, "partial", None)],
        "query_id string, scope_kind string, scope_owner string, text string, expect_min_gate string, expect_max_gate string, expect_substring string",
    )
    got = {r["query_id"]: r for r in retrieve.selfcheck(p, tables, as_of=F.lit(NOW).cast("timestamp_ntz"), embed=hash_embed(DIM)).collect()}
    assert got["a"]["passed"] and got["b"]["passed"] and got["d"]["passed"] and not got["c"]["passed"]
    assert got["c"]["detail"] == 'gate was "full", wanted at most "partial"; expected retrieved context to contain "absent", it didn\'t'


def test_search_batch_skips_anchors(spark, tables):
    q = spark.createDataFrame([(1, *A, *A, "zz plorf"), (2, *A, *A, "chess")], "query_id int, acting_kind string, acting_owner string, scope_kind string, scope_owner string, text string")
    hits = retrieve.search_batch(q, tables, as_of=F.lit(NOW).cast("timestamp_ntz"), embed=hash_embed(DIM), limit=4).collect()
    assert {r["query_id"] for r in hits} == {2} and len(hits) == 4 and all(len(r["text"]) <= 500 for r in hits)
