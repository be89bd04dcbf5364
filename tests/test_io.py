"""Bundles, transcripts, merges and streams on small fixtures."""

import datetime as dt
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from memspark.operators import scope as S
from memspark.session import materialize, shared_dir
from memspark.sources import bundle, chats, tables
from memspark.streaming import jobs
from tests.test_operators import A, B


@pytest.fixture()
def tree(tmp_path):
    def put(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("manifest.json", json.dumps({"created_by": "x", "scopes": [
        {"scope_kind": "private", "scope_owner": "user:a", "dir": "scopes/private-user_a", "episode_count": 2}, {"scope_kind": "shared", "scope_owner": "team:b", "dir": "scopes/shared-team_b"}]}, indent=1))
    ep = {"id": "ep_1", "ts": "2024-01-05T10:00:00Z", "type": "interaction", "input_text": "hi", "output_text": "yo", "hash": "h1", "retrieved_refs": [{"kind": "summary", "scope": {"kind": "private", "owner": "user:a"}, "id": "s"}]}
    put("scopes/private-user_a/episodes/2024/01/2024-01-05.jsonl", json.dumps(ep) + "\n" + json.dumps({**ep, "id": "ep_2", "hash": "h2"}) + "\n")
    put("scopes/shared-team_b/episodes/2024/01/2024-01-05.jsonl", json.dumps({**ep, "id": "ep_3"}) + "\n")
    versions = [{"id": "v1", "period": "2024-01-05", "level": "daily", "summary": "a", "created_at": "2024-01-06T00:00:00Z", "key_facts": [{"fact": "f1", "grounded": True}, {"fact": "f2", "grounded": False, "source_count": 3}]},
                {"id": "v2", "period": "2024-01-05", "level": "daily", "summary": "b", "supersedes": "v1", "created_at": "2024-01-07T00:00:00Z"}]
    put("scopes/private-user_a/summaries/daily/2024-01-05.json", json.dumps(versions, indent=2))
    put("scopes/private-user_a/entities.jsonl", json.dumps({"id": "person:x", "kind": "person", "name": "X", "first_seen": "2024-01-01T00:00:00Z", "attributes": {"age": 7, "job": "cook"}}) + "\n")
    put("scopes/private-user_a/memory_relations.jsonl", json.dumps({"relation_type": "updates", "from": {"summary_id": "v2", "fact": "f"}, "to": {"entity_id": "person:x", "attribute_key": "job"}}) + "\n")
    return str(tmp_path)


def test_exchange_tree(spark, tree):
    e = {r["id"]: r for r in bundle.read_tree_episodes(spark, tree).collect()}
    assert {i: r["scope_owner"] for i, r in e.items()} == {"ep_1": "user:a", "ep_2": "user:a", "ep_3": "team:b"}
    assert e["ep_1"]["retrieved_refs"][0]["scope"]["owner"] == "user:a"
    s = bundle.read_tree_summaries(spark, tree)
    assert [(r["fact"], r["grounded"], r["source_count"]) for r in bundle.summary_facts(s).orderBy("fact_no").collect()] == [("f1", True, 1), ("f2", False, 3)]
    n = bundle.read_tree_entities(spark, tree).first()
    assert n["attributes"] == {"age": "7", "job": "cook"} and n["scope_owner"] == "user:a"
    assert bundle.read_tree_relations(spark, tree).first()["to"]["attribute_key"] == "job"


def test_tree_summaries_merge_with_new_numbers(spark, tree):
    s = bundle.read_tree_summaries(spark, tree)
    rows, ids = bundle.import_merge_summaries(s.filter("1 = 0"), s)
    got = {r["exported_id"]: (r["id"], r["supersedes"], r["dangling"]) for r in rows.collect()}
    assert got == {"v1": ("sum_user:a_2024-01-05_daily_v1", None, False), "v2": ("sum_user:a_2024-01-05_daily_v2", "sum_user:a_2024-01-05_daily_v1", False)}
    again, _ = bundle.import_merge_summaries(rows.select(*s.columns), s)
    assert again.count() == 0 and ids.count() == 2


def test_import_renames_taken_ids_and_follows_references(spark):
    ddl = "scope_kind string, scope_owner string, id string, ts timestamp, hash string, refers_to string"
    t = dt.datetime(2024, 1, 1)
    have = spark.createDataFrame([(*B, "ep_1", t, "x", None), (*A, "ep_9", t, "seen", None)], ddl)
    inc = spark.createDataFrame([(*A, "ep_1", t, "h1", None), (*A, "ep_2", t, "h2", "ep_1"), (*A, "ep_3", t + dt.timedelta(1), "h2", None), (*A, "ep_4", t, "seen", None), (*A, "ep_1", t, "h1", None)], ddl)
    rows, stats = bundle.import_merge_episodes(have, inc)
    got = {r["hash"]: r for r in rows.collect()}
    assert set(got) == {"h1", "h2"} and got["h1"]["id"] != "ep_1" and got["h1"]["id"].startswith("ep_1704067200000")
    assert got["h2"]["id"] == "ep_2" and got["h2"]["refers_to"] == got["h1"]["id"]
    assert tuple(stats.select("imported", "skipped").first()) == (2, 3)


def test_samples_with_dynamic_keys(spark, tmp_path):
    doc = [{"sample_id": "c1", "conversation": {
        "speaker_a": "Al", "session_2": [{"speaker": "Al", "text": "two"}], "session_2_date_time": "3:04 pm on 2 January, 2006", "session_10": [{"speaker": "Bo", "text": "", "img_url": ["http://x/y/z.jpg"], "blip_caption": "a cat"}],
        "session_10_date_time": " 1:56 pm on 8 May, 2023 "}, "qa": [{"question": "q", "answer": 2022, "category": 1}, {"question": "r", "adversarial_answer": "no", "category": 5}]}]
    p = tmp_path / "s.json"
    p.write_text(json.dumps(doc))
    s = chats.read_samples(spark, str(p))
    got = [tuple(r) for r in chats.sample_turns(s).select("session_no", F.col("session_at").cast("string"), "speaker", "text").orderBy("session_no").collect()]
    assert got == [(2, "2006-01-02 15:04:00", "Al", "two"), (10, "2023-05-08 13:56:00", "Bo", "[Shared image: z.jpg]\na cat")]
    assert [r["answer"] for r in chats.sample_questions(s).orderBy("question_no").collect()] == ["2022", None]


def test_haystacks_refuse_unequal_lists(spark, tmp_path):
    ok = {"question_id": "a", "haystack_dates": ["2023/05/20 (Sat) 02:21"], "haystack_sessions": [[{"role": "user", "content": "hi"}]]}
    p = tmp_path / "h.json"
    p.write_text(json.dumps([ok, {**ok, "question_id": "b", "haystack_dates": []}]))
    turns, bad = chats.haystack_turns(chats.read_haystacks(spark, str(p)))
    assert [r["question_id"] for r in turns.collect()] == ["a"] and [r["question_id"] for r in bad.collect()] == ["b"]


def test_sessions_take_the_last_date_and_split_long_ones(spark):
    rows = [(1, "1:00 pm on 1 May, 2023", "a", "x", 0), (1, "", "b", "y", 1), (1, "2:00 pm on 1 May, 2023", "a", "z", 2), (2, " ", "a", "w", 0)]
    t = spark.createDataFrame(rows, "session_index int, session_datetime string, speaker string, text string, ord int")
    good, bad = chats.sessionize_turns(t, per_part=2)
    assert [(r["part_no"], r["text"], str(r["session_at"])) for r in good.orderBy("part_no").collect()] == [(0, "a: x\nb: y", "2023-05-01 14:00:00"), (1, "a: z", "2023-05-01 14:00:00")]
    assert [r["session_index"] for r in bad.collect()] == [2]


def test_tables_round_trip_by_scope_and_day(spark, tmp_path):
    e = spark.createDataFrame([(*A, "1", dt.datetime(2024, 1, 1, 5)), (*B, "2", dt.datetime(2024, 1, 2, 5))], "scope_kind string, scope_owner string, id string, ts timestamp")
    tables.write_table(e, str(tmp_path), "episodes")
    back = tables.load_table(spark, str(tmp_path), "episodes")
    assert sorted((r["id"], str(r["day"])) for r in S.scope_filter(back, A, A).collect()) == [("1", "2024-01-01")]
    assert os.path.isdir(tmp_path / "episodes" / "scope_kind=private" / "day=2024-01-01")


def test_late_rows_are_stored_once(spark, tmp_path):
    ddl = "scope_kind string, scope_owner string, id string, ts timestamp, input_text string, output_text string"
    src = tmp_path / "in"
    day = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[(*A, "1", day(10), "a", "b"), (*A, "1", day(10, 5), "a", "b")], [(*A, "2", day(15), "c", "d"), (*B, "1", day(15), "a", "b")], [(*A, "1", day(15, 1), "a", "b"), (*A, "late", day(3), "x", "y"), (*A, "3", day(16), "x", "y")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(f"{src}/b{i}")
    out = tmp_path / "out"
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = jobs.capture(stream).writeStream.option("checkpointLocation", str(tmp_path / "st")).trigger(availableNow=True).foreachBatch(jobs.write_new(str(out), ["scope_kind", "scope_owner", "id"])).start()
    q.awaitTermination()
    got = sorted((r["scope_owner"], r["id"], r["ts"].hour) for r in spark.read.parquet(str(out)).collect())
    assert len(got) == 5 and ("user:a", "late", 3) in got and ("user:b", "1", 15) in got and ("user:a", "2", 15) in got
    assert [g for g in got if g[:2] == ("user:a", "1")][0] == ("user:a", "1", 10)


def test_repeated_batches_replace_themselves(spark, tmp_path):
    df = spark.createDataFrame([(*A, "interaction", dt.datetime(2024, 1, 1))], "scope_kind string, scope_owner string, type string, ts timestamp")
    add = jobs.corpus_counter(str(tmp_path))
    for batch in (0, 1, 1):
        add(df, batch)
    assert jobs.corpus_table(spark, str(tmp_path)).first()["episode_count"] == 2


def test_rate_limit_counts_denied_events(spark):
    rows = [(1, i, dt.datetime(2024, 1, 1, 0, 0, s)) for i, s in enumerate([0, 1, 2, 9, 10, 11, 11])]
    df = spark.createDataFrame(rows, "u int, i int, ts timestamp")
    got = [(r["n"], r["allowed"]) for r in jobs.rate_limit(df, ["u"], seconds=10, limit=3, tie="i").orderBy("i").collect()]
    assert got == [(1, True), (2, True), (3, True), (4, False), (4, False), (4, False), (5, False)]


def test_turns_close_after_silence(spark):
    t = lambda m: dt.datetime(2024, 1, 1, 10, m)
    rows = [(*A, "k", t(0), None, "read"), (*A, "k", t(5), "", "grep"), (*A, "k", t(10), "done", "read"), (*A, "k", t(40), "later", None), (*B, "k", t(1), "x", None)]
    df = spark.createDataFrame(rows, "scope_kind string, scope_owner string, turn_key string, ts timestamp, answer string, tool string")
    got = [(r["n_requests"], r["answer"], r["tags"]) for r in jobs.agent_turns(df).filter("scope_owner = 'user:a'").orderBy("started").collect()]
    assert got == [(3, "done", ["agent", "tool:read", "tool:grep"]), (1, "later", [])]


def test_scratch_lies_in_the_shared_folder(spark):
    df = materialize(spark.range(3).toDF("n"), "probe")
    wanted = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0]
    assert df.count() == 3 and shared_dir(spark) == wanted


def test_scratch_without_any_spark_settings(tmp_path):
    """A fresh local session that names no folder makes its own one; checkpoints and written stages work."""
    code = (
        "from pyspark.sql import SparkSession\nfrom memspark.session import cut_lineage, materialize\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print('rows', materialize(s.range(3), 'a').count() + cut_lineage(s.range(4)).count())"
    )
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True, timeout=300)
    assert "rows 7" in done.stdout, done.stderr[-2000:]
