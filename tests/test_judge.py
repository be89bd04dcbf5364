"""The judge slot: batches, retries, errors of single prompts, and what is resolved from the answers."""

import json

from pyspark.sql import functions as F

from memspark.operators import panels, versions
from memspark.plans import judge
from memspark.plans.hints import aggregation_hint


def test_failing_calls_are_repeated_and_then_split(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(50)] + [(50, "bad"), (51, "short")], "id int, prompt string").coalesce(1)

    def answer(some, calls=[]):  # noqa: B006 - one list per worker counts the calls
        calls.append(len(some))
        if len(calls) == 1:
            raise TimeoutError("once")
        if "bad" in some:
            raise ValueError("refused")
        return [p.upper() for p in some if p != "short"]

    rows = {r["id"]: (r["answer"], r["error"]) for r in judge.ask_judge(prompts, answer, batch=20, retries=1).collect()}
    assert all(rows[i] == (f"P{i}", None) for i in range(50))
    assert rows[50] == (None, "ValueError: refused") and rows[51] == (None, "0 answers to 1 prompts")
    assert judge.ask_judge(prompts.limit(0), answer).count() == 0


def test_attribution_from_a_judge(spark):
    a = spark.createDataFrame([(1, "yes a", ["a", "b"]), (2, "none", ["c"]), (3, "odd", ["d", "e"])], "id int, reply string, citations array<string>")

    def answer(some):
        out = []
        for p in some:
            cites = json.loads(p.split("\n")[1].removeprefix("CITATIONS "))
            reply = p.split("\n")[2].removeprefix("REPLY ")
            out.append("text " + json.dumps({"used": [c in reply for c in cites][: 1 if reply == "odd" else None]}))
        return out

    got = {(r["id"], r["citation"]): r["used"] for r in judge.judged_attribution(a, ["id"], answer).collect()}
    assert got == {(1, "a"): True, (1, "b"): False, (2, "c"): False, (3, "d"): None, (3, "e"): None}


def test_rejected_updates_name_their_reason(spark):
    ddl = "scope_kind string, scope_owner string, subject_kind string, subject_name string, predicate string, object_kind string, object_name string, valid_from string, valid_until string, arrival bigint"
    rows = [
        ("private", "u", "person", "Ann", "likes", "place", "Oslo", None, None, 1), ("private", "u", "robot", "Ann", "likes", "place", "Oslo", None, None, 2),
        ("private", "u", "person", "Ann", "é" * 33, "place", "Oslo", None, None, 3), ("private", "u", "person", "Ann", None, "place", "Oslo", None, None, 4),
        ("private", "u", "person", "--", "likes", "place", "Oslo", None, None, 5), ("private", "u", "person", "Ann", "likes", "place", "Rome", None, None, 6),
        ("private", "v", "person", "Ann", "likes", "place", "Oslo", None, None, 7), ("private", "u", None, "Ann", "likes", "place", "Oslo", None, None, 8),
    ]
    u = spark.createDataFrame(rows, ddl)
    e = spark.createDataFrame([("private", "u", "person:ann"), ("private", "u", "place:oslo"), ("private", "u", "place:oslo")], "scope_kind string, scope_owner string, id string")
    got = {r["arrival"]: r["reason"] for r in versions.rejected_edges(u, e).collect()}
    assert got == {2: "unknown kind", 3: "predicate too long", 4: "no predicate", 5: "no identifier", 6: "unknown entity", 7: "unknown entity", 8: "unknown kind"}
    kept = versions.endpoint_semi(versions.normalise_edges(u), e)
    assert {r["arrival"] for r in kept.collect()} == {1}


def test_hints_go_to_questions_that_ask_for_a_pair(spark):
    f = spark.createDataFrame([(k, i, f"e{i}", f"2024-01-0{i}") for k in (1, 2) for i in (1, 2)], "k int, fact_id int, description string, d string")
    f = f.withColumn("date", F.col("d").cast("date"))
    q = spark.createDataFrame([(1, "Two days IN A ROW?"), (2, "what came first?")], "k int, question string")
    got = aggregation_hint(f, ["k"], F.lit("2024-01-31").cast("timestamp_ntz"), questions=q)
    assert [r["k"] for r in got.collect()] == [1]


def test_clamped_limits(spark):
    rows = spark.createDataFrame([(None,), (-1,), (0,), (7,), (99,)], "n int")
    assert [r[0] for r in rows.select(panels.clamped(F.col("n"), 20, 50)).collect()] == [panels.clamp(n, 20, 50) for n in (None, -1, 0, 7, 99)] == [20, 20, 20, 7, 50]
