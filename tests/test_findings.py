"""Cases of a review's findings."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from memspark.operators import counting, matching
from memspark.operators.scope import SCOPE
from memspark.plans import consolidate
from memspark.session import materialize
from memspark.sources import bundle
from memspark.streaming import turns
from tools.check_oracle import canon


def beside_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over given frames."""
    con = duckdb.connect()
    for table, rows in tables.items():
        rows.write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = entry.queries()[name](spark, str(folder))
    cur = con.execute(entry.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    got = sorted(tuple(canon(r[c]) for c in have) for r in df.collect())
    return got, sorted(tuple(canon(v) for v in r) for r in cur.fetchall())


def documents(spark, *texts):
    return spark.createDataFrame([(i, s, "en", "web", len(s)) for i, s in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_words_and_grams_are_not_broadcast(spark):
    words = materialize(spark.createDataFrame([("p", "u", "anderes"), ("p", "u", "under")], "scope_kind string, scope_owner string, word string"))
    pieces = materialize(spark.createDataFrame([("p", "u", "nder"), ("p", "u", "u"), ("q", "u", "der")], "scope_kind string, scope_owner string, piece string"))
    df = matching.pieces_in_words(words, pieces, SCOPE)
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["word"], r["piece"]) for r in df.collect()) == [("anderes", "nder"), ("under", "nder"), ("under", "u")]


def test_equal_facts_are_counted_once_before_names_are_looked_for(spark):
    f = spark.createDataFrame([(1, "s1", "Ann met Bo", "2024-01-02"), (2, "s2", "Ann met Bo", "2024-01-01"), (3, "s3", "Bo left", "2024-01-01")], "id long, summary_id string, fact string, period string")
    e = spark.createDataFrame([("person:ann", "Ann"), ("person:bo", "Bo")], "id string, name string")
    scope = [F.lit("private").alias("scope_kind"), F.lit("user:1").alias("scope_owner")]
    once = counting.first_of_equal(f.select(*scope, "*"))
    assert sorted(r["id"] for r in once.collect()) == [2, 3]
    got = counting.exhaustive_count_facts(f.select(*scope, "*"), e.select(*scope, "*"))
    assert sorted((r["entity_id"], r["number"], r["id"], r["fact"]) for r in got.collect()) == [("person:ann", 1, 2, "Ann met Bo"), ("person:bo", 1, 2, "Ann met Bo"), ("person:bo", 2, 3, "Bo left")]


def test_paraphrases_of_large_ids_have_their_own_query(spark, tmp_path):
    v = spark.range(99_990, 100_020).select(F.col("id").alias("vec_id"), F.array(*[F.sin(F.col("id") * n).cast("float") for n in range(1, 9)]).alias("embedding"), (F.col("id") % 2).cast("int").alias("label"))
    got, want = beside_sql(spark, tmp_path, "best_over_paraphrases", embeddings=v.union(v.withColumn("vec_id", F.col("vec_id") - 99_990)))
    assert got == want


def test_entity_without_a_slug_is_named_by_its_name_alone(spark, tmp_path):
    c = spark.createDataFrame([(1, 0, "user", "hello there"), (2, 1, "user", "\u041f\u0440\u0438\u0432\u0435\u0442 again")], "conv_id long, turn long, role string, text string")
    got, want = beside_sql(spark, tmp_path, "memory_gate", documents=documents(spark, "\u041f\u0440\u0438\u0432\u0435\u0442 world", "some text"), conversations=c)
    assert got == want and [r[1] for r in got] == ["int:0", "int:1"]


def test_every_sentence_is_a_predicate(spark, tmp_path):
    d = documents(spark, "Lives in Rome. Works at Acme. ", "One. Based_In . " + "x" * 70 + ".Two", "", " based_in .b")
    got, want = beside_sql(spark, tmp_path, "predicate_norm", documents=d)
    assert got == want and len(got) == 10
    said = {r[2] for r in got}
    assert {"str:works at acme", "str:two", "str:lives_in", "str:based_in", "str:"} <= said


def test_search_finds_only_what_is_asked_for(spark):
    from memspark.functions.vectors import hash_embed
    from memspark.plans import retrieve
    from tests.conftest import SMALL
    from memspark.registry import Tables
    from memspark.registry import retrieval as R
    from memspark.registry.views import as_of

    t = Tables(spark, SMALL)
    s = retrieve.Search(R.asked(t).limit(3), R.memory(t), as_of=as_of(), embed=hash_embed(64))
    assert s.pool.count() > 0
    assert not {"picks", "pick_facts", "episodes", "entities", "counted"} & set(vars(s))


def test_rows_of_a_hot_key_do_not_meet_in_a_task_to_be_cut(spark):
    from memspark.operators.cells import cut_into_cells

    rows = materialize(spark.range(1000).select(*[F.lit("x").alias(c) for c in SCOPE], "id"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left, right, cell = cut_into_cells(rows, rows, SCOPE, ["id"], ["id"], 100, 300)
        for side in (left, right):
            plan = side._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and all("FullOuter" in line for line in plan.splitlines() if "SortMergeJoin" in line)
        assert left.count() == 4 * 1000 and right.count() == 10 * 1000
        assert left.select(cell).distinct().count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_asked_terms_travel_as_numbers(spark):
    from memspark.operators import bm25

    scope = [F.lit("private").alias("scope_kind"), F.col("owner").alias("scope_owner")]
    docs = spark.createDataFrame([("a", 1, "red red apple"), ("a", 2, "green apple"), ("b", 3, "red house")], "owner string, doc_id long, text string").select(*scope, "doc_id", "text")
    asked = spark.createDataFrame([("a", 1, "red apple"), ("b", 2, "apple red"), ("a", 3, "house")], "owner string, query_id long, text string").select(*scope, "query_id", "text")
    terms = bm25.query_terms(asked)
    numbers = bm25.numbered_terms(terms)
    assert numbers.count() == 5 == numbers.select("no").distinct().count()
    posts = bm25.matching_postings(bm25.doc_tokens(docs), terms, numbers=numbers)
    assert dict(posts.dtypes)["term"] == "bigint" and posts.count() == 4
    top = bm25.bm25_topk(docs, asked)
    assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in top.collect()) == [(1, 1, 0), (1, 2, 1), (2, 3, 0)]


def test_entities_and_queries_are_not_broadcast(spark):
    scope = [F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner")]
    e = spark.createDataFrame([("project:red", "Red"), ("project:blue-sky", "Blue sky"), ("project:-", "\u041f\u043e\u043b\u0435")], "id string, name string")
    e = e.select(*scope, "id", "name", F.lit("project").alias("kind"), F.lit("2024-01-30").cast("date").alias("last_updated"))
    q = spark.createDataFrame([(1, "the blue sky, yesterday"), (2, "a reddish blue"), (3, "last year: red")], "query_id long, text string").select(*scope, "*")
    found = matching.stage1_entity_match(q, e, F.lit("2024-01-31 12:00:00").cast("timestamp_ntz"))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["query_id"], r["id"]) for r in found.collect()) == [(1, "project:blue-sky"), (2, "project:red")]


def test_triggers_of_few_entities_fetch_no_postings(spark, monkeypatch):
    """Before, triggers that need a hub went over all its summaries."""
    monkeypatch.setattr(consolidate, "_specific_to_many", lambda *a: (_ for _ in ()).throw(AssertionError("postings fetched")))
    scope = [F.lit("private").alias("scope_kind"), F.lit("user:1").alias("scope_owner")]
    d = spark.range(60).select(
        *scope, F.format_string("d%02d", "id").alias("id"), F.array_compact(F.array(F.lit("hub"), F.when(F.col("id") % 20 == 3, F.lit("rare")), F.when(F.col("id") % 2 == 0, F.lit("even")))).alias("entities_touched"),
        F.lit(None).cast("string").alias("supersedes"), F.when(F.col("id") != 59, F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("id").cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(18,6)"))).alias("created_at"),
    )
    asked = d.filter("id in ('d03', 'd10', 'd58')")
    got = {}
    for r in consolidate.entity_specificity(d, asked, hub_rows=0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == {"d03": ["d43", "d23", "d58", "d57", "d56"], "d10": ["d58", "d56", "d54", "d52", "d50"], "d58": ["d56", "d54", "d52", "d50", "d48"]}
    assert consolidate.entity_specificity(d.filter("id = 'd59'"), d.filter("id = 'd59'")).count() == 0


def test_bundles_and_exports_are_packed(spark, tmp_path):
    scope = [F.lit("private").alias("scope_kind"), F.format_string("user:%d", F.col("id") % 3).alias("scope_owner")]
    rows = spark.range(50).select(*scope, F.format_string("x%d", "id").alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 86_400).alias("ts"), F.lit("person").alias("kind"), F.lit("interaction").alias("type"))
    bundle.write_bundle(f"{tmp_path}/b", episodes=rows, summaries=rows, entities=rows, relations=rows.select(*scope[:1], "scope_owner", F.lit("updates").alias("relation_type")))
    bundle.write_memory_export(rows.select("scope_kind", "scope_owner", F.lit(1).alias("section"), F.col("id").alias("sort_key"), F.lit("x").alias("line")), f"{tmp_path}/e")
    files = [f for f in tmp_path.rglob("part-*")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    for name in ("episodes", "summaries", "entities"):
        assert {r["id"] for r in bundle.read_bundle(spark, f"{tmp_path}/b", name).collect()} == {f"x{i}" for i in range(50)}
    assert spark.read.json(f"{tmp_path}/e").count() == 50


def test_relations_carry_their_other_end_along(spark):
    """Before, every relation got a hash under which its resolved ends were joined again."""
    loc = "struct<summary_id:string,fact:string,entity_id:string,attribute_key:string>"
    kinds = f"scope_kind string, scope_owner string, relation_type string, from {loc}, to {loc}"
    a, b, attr, no = ("o1", "A", None, None), ("o2", "B", None, None), (None, None, "e", "k"), ("o1", "?", None, None)
    inc = spark.createDataFrame([("p", "u", "updates", a, b), ("p", "u", "updates", a, b), ("p", "u", "derives", b, attr), ("p", "u", "updates", no, b), ("p", "w", "updates", a, b), ("p", "u", "updates", b, a)], kinds)
    ids = spark.createDataFrame([("p", "u", "o1", "s1"), ("p", "u", "o2", "s2")], "scope_kind string, scope_owner string, exported_id string, summary_id string")
    facts = spark.createDataFrame([("p", "u", 1, "s1", "A"), ("p", "u", 2, "s2", "B")], "scope_kind string, scope_owner string, id long, summary_id string, fact string")
    heads = spark.createDataFrame([("p", "u", "e", "k", "m9")], "scope_kind string, scope_owner string, entity_id string, attribute_key string, id string")
    have = spark.createDataFrame([("p", "u", "mem_fact_2", "mem_fact_1", "updates")], "scope_kind string, scope_owner string, from_memory_id string, to_memory_id string, relation_type string")
    out = bundle.import_merge_relations(have, inc, summary_ids=ids, facts=facts, heads=heads)
    assert sorted(tuple(r)[2:] for r in out.collect()) == [("mem_fact_1", "mem_fact_2", "updates"), ("mem_fact_2", "m9", "derives")]
    assert "sha2" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_turns_are_folded_without_a_frame_each(monkeypatch):
    """Before, every turn of a key cost a pandas group and two filters."""
    monkeypatch.setattr(pd.DataFrame, "groupby", lambda *a, **k: (_ for _ in ()).throw(AssertionError("a frame for each turn")))
    rows = pd.DataFrame([(30, 40, "z", "t"), (0, 10, "a", None), (5, 15, "c", "u"), (5, 15, "b", "t"), (15, 25, "", "u"), (24, 34, None, "")], columns=["at", "end", "answer", "tool"])
    assert turns.stretches(rows) == [(0, 15, 3, "c", 5, ["t", "u"], [5, 5]), (15, 40, 3, "z", 30, ["u", "t"], [15, 30])]


def test_facts_travel_once_through_their_terms(spark):
    from memspark.operators import fusion

    facts = spark.createDataFrame([("s", 1, "alpha beta beta", 0.5, 1), ("s", 2, "beta", None, 2), ("s", 3, "", 0.1, 1), ("t", 4, "gamma", 0.2, 1)], "summary_id string, fact_id long, text string, similarity double, source_count int")
    queries = spark.createDataFrame([("s", "beta alpha"), ("t", "")], "summary_id string, text string")
    ranked = fusion.keyfact_rank(facts, queries, ["summary_id"])
    rows = {r["fact_id"]: r for r in ranked.collect()}
    assert {i: (r["text"], r["similarity"], r["fact_rank"]) for i, r in rows.items()} == {1: ("alpha beta beta", 0.5, 0), 2: ("beta", None, 1), 3: ("", 0.1, 2), 4: ("gamma", 0.2, 0)}
    # no whole rows travel with every term
    plan = ranked.select("fact_id", "fact_rank")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "_row#" not in plan


def cell_rows(monkeypatch, module):
    """Rows that ``module`` sends to cells, left and right, by call."""
    seen, match = [], module.match_cells

    def counted(left, right, cell, kernel, schema):
        seen.append((left.count(), right.count()))
        return match(left, right, cell, kernel, schema)

    monkeypatch.setattr(module, "match_cells", counted)
    return seen


def test_equal_vectors_meet_the_queries_once(spark, monkeypatch):
    """Before, every row went to every block of queries, however many had the same vector."""
    from memspark.operators import search

    kinds = [[1.0, 0.0], [0.0, 1.0], [0.8, 0.6]]
    rows = spark.createDataFrame([("p", "u", f"g{i % 50:02d}", kinds[i % 3]) for i in range(600)] + [("p", "u", "g00", [0.0, 0.0]), ("p", "u", "n", None)], "scope_kind string, scope_owner string, id string, vector array<float>")
    asked = spark.createDataFrame([("p", "u", i, kinds[i], f"g{i:02d}") for i in range(3)], "scope_kind string, scope_owner string, query_id long, query_vector array<float>, self_id string")
    seen = cell_rows(monkeypatch, search)
    got = search.vector_topk(rows, asked, k=4, exclude_self=True).orderBy("query_id", "rank").collect()
    assert seen == [(4, 3)]
    # every group has every vector, so the smallest others win at similarity one
    assert [(r["query_id"], r["id"], r["sim"], r["rank"]) for r in got] == [(q, g, 1.0, n) for q in range(3) for n, g in enumerate([g for g in ("g00", "g01", "g02", "g03", "g04") if g != f"g{q:02d}"])]


def test_many_near_vectors_of_one_group_hide_no_other_group():
    from memspark.operators import kernels

    sims = np.r_[np.linspace(0.99, 0.9, 200), 0.5, 0.4, 0.3]
    sizes, starts, codes = np.ones(203, np.int64), np.arange(203), np.r_[np.zeros(200, np.int64), 2, 1, 3]
    group, sim = kernels.best_groups(sims, sizes, starts, codes, 3, 0.35, 6, -1)
    assert (group.tolist(), sim.tolist()) == ([0, 2, 1], [0.99, 0.5, 0.4])
    group, _ = kernels.best_groups(sims, sizes, starts, codes, 3, -1.0, 6, 0)
    assert group.tolist() == [2, 1, 3]


def test_documents_and_queries_go_to_cells_as_one_row(spark, monkeypatch):
    """Before, every term of a document went to every block of queries as a row of its own, and the other way round."""
    from memspark.operators import bm25

    scope = [F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner")]
    words = [f"w{i:03d}" for i in range(100)]
    texts = [(i, " ".join(words[: i + 1])) for i in range(100)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").select(*scope, "*")
    asked = spark.createDataFrame([(1, " ".join(words)), (2, "w099 nothing")], "query_id long, text string").select(*scope, "*")
    seen = cell_rows(monkeypatch, bm25)
    got = bm25.bm25_topk(docs, asked, k=2).orderBy("query_id", "rank").collect()
    assert seen == [(100, 2)]
    assert [(r["query_id"], r["doc_id"]) for r in got if r["query_id"] == 2] == [(2, 99)] and len(got) == 3


def test_documents_of_one_id_count_as_before(spark):
    """Rows of one id and length are one document; with another length they add up."""
    from memspark.operators import bm25

    scope = [F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner")]
    docs = spark.createDataFrame([(1, "red red"), (1, "red blue"), (1, "red"), (2, "green")], "doc_id long, text string").select(*scope, "*")
    posts = bm25.packed_postings(docs, bm25.query_terms(docs.select(*scope, F.col("doc_id").alias("query_id"), "text")))
    assert sorted((r["doc_id"], r["doc_len"], r["copies"], sorted(r["tfs"])) for r in posts.collect()) == [(1, 1, 1, [1]), (1, 2, 2, [1, 3]), (2, 1, 1, [1])]
    top = bm25.bm25_topk(docs, docs.limit(1).select(*scope, F.lit(7).cast("long").alias("query_id"), F.lit("red").alias("text")))
    assert [(r["doc_id"], r["rank"]) for r in top.collect()] == [(1, 0)]


def test_candidates_carry_packed_tokens_to_their_query(spark):
    """Before, every candidate carried a 64-bit hash for each of its tokens."""
    from memspark.operators import fusion

    words = [f"word{i}" for i in range(400)]
    docs = [(f"d{i}", words[i * 10 : i * 10 + 200]) for i in range(6)] + [("e", [])]
    rows = spark.createDataFrame([("p", "u", 1, d, 1.0 - i / 100, w) for i, (d, w) in enumerate(docs)], "scope_kind string, scope_owner string, query_id long, id string, relevance double, tokens array<string>")
    packed = rows.withColumn("tokens", fusion.packed_tokens(F.col("tokens")))
    assert packed.select(F.max(F.octet_length("tokens"))).first()[0] < 8 * 200 / 2
    plain, small = ([(r["pick"], r["id"]) for r in fusion.mmr_select(x, k=3).orderBy("pick").collect()] for x in (rows, packed))
    rel, near, left, want = {d: 1.0 - i / 100 for i, (d, _) in enumerate(docs)}, dict.fromkeys(dict(docs), 0.0), [d for d, _ in docs], []
    for _ in range(3):
        want.append(max(left, key=lambda d: 0.7 * rel[d] - 0.3 * near[d]))
        left.remove(want[-1])
        a = set(dict(docs)[want[-1]])
        near = {d: max(n, len(a & set(dict(docs)[d])) / max(1, len(a | set(dict(docs)[d])))) for d, n in near.items()}
    assert plain == small == list(enumerate(want))


def test_lines_need_only_the_facts_they_can_show(spark):
    """Before, all facts of every picked summary were packed for its lines, twice."""
    from memspark.operators import fusion

    facts = [("s", i, (7 * i) % 40, f"fact {i} " + "x" * (i % 90), i == 0) for i in range(40)] + [("t", i, 2 - i, f"few {i}" * 200, False) for i in range(3)]
    rows = spark.createDataFrame(facts, "summary_id string, fact_id long, fact_rank int, text string, most_relevant boolean")
    rows = rows.withColumn("lines_before", fusion.lines_before(["summary_id"])).withColumn("n_facts", F.when(F.col("summary_id") == "s", 40).otherwise(3))
    shown = rows.filter(fusion.may_be_shown(F.col("n_facts"), F.col("lines_before")))
    assert shown.filter("summary_id = 's'").count() < 30 and shown.filter("summary_id = 't'").count() == 3

    def lines(df, n):
        packed = df.groupBy("summary_id").agg(F.collect_list(F.struct("fact_rank", "fact_id", "text", "most_relevant")).alias("facts"), F.max("n_facts").alias("n"))
        line = fusion.guarantee_line(F.lit("p: "), F.lit("prose"), F.col("facts"), F.lit(400), n)
        return sorted(packed.select("summary_id", line.alias("line"), fusion.depth_text(F.lit("prose"), F.col("facts")).alias("depth")).collect())

    assert lines(rows, None) == lines(shown, F.col("n"))


def test_names_go_by_number_and_grams_are_counted_first(spark):
    """Before, every hit carried its entity's id through the shuffle, and words were sent by each of their grams to be counted."""
    texts = spark.createDataFrame([("p", "u", i, "red redder blue sky" if i % 2 else "greenery  blue sky red") for i in range(20)], "scope_kind string, scope_owner string, text_id long, text string")
    names = spark.createDataFrame([("p", "u", n, w) for n, w in (("a", "red"), ("a", "dder"), ("b", "blue sky"), ("c", "green"), ("c", "green"), ("d", "e"), ("x", "zz"), ("y", " "))], "scope_kind string, scope_owner string, name_id string, name string")
    hits = matching.names_in_texts(texts, names)
    want = {(i, n) for i in range(20) for n in ("a", "b", "d", "y") + (() if i % 2 else ("c",))}
    got = [(r["text_id"], r["name_id"]) for r in hits.collect()]
    assert len(got) == len(want) and set(got) == want
    lines = [x for x in hits._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_set" in x]
    assert lines and all("collect_set(no#" in x for x in lines)
    words = materialize(spark.range(300).select(*[F.lit("x").alias(c) for c in SCOPE], F.format_string("abcdefgh%05d", "id").alias("word")))
    pieces = materialize(spark.createDataFrame([("x", "x", "abc"), ("x", "x", "00007")], "scope_kind string, scope_owner string, piece string"))
    found = matching.pieces_in_words(words, pieces, SCOPE)
    assert found.filter("piece = '00007'").count() == 1 and found.count() == 301
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_lists_of_sets_leave_their_order_behind(spark):
    """Before, each document of a list carried what the list was ordered by to every trigger."""
    held = lambda *t: [(x, 1) for x in t]
    rows = [("p", "u", "a", "2024-01-02", held("x")), ("p", "u", "b", "2024-01-03", held("x", "y")), ("p", "u", "c", None, held("x"))]
    docs = spark.createDataFrame(rows, "scope_kind string, scope_owner string, doc_id string, created_at string, held array<struct<term:string,times:bigint>>")
    docs = docs.withColumn("created_at", F.col("created_at").cast("timestamp_ntz")).withColumn("plain", F.lit(True))
    stats = docs.select(*SCOPE, F.inline("held")).groupBy(*SCOPE, "term").agg(F.sum("times").alias("_freq"))
    asked = spark.createDataFrame([("p", "u", "a", ["x", "y"])], "scope_kind string, scope_owner string, query_id string, terms array<string>")
    best = consolidate.best_of_sets(docs, stats, asked, 5, 3)
    assert [(r["doc_id"], r["score"]) for r in best.orderBy("rank").collect()] == [("b", 1.333333333), ("c", 0.333333333)]
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(struct(doc_id" in plan and "collect_list(r#" not in plan
