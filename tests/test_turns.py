"""Agent turns in bounded state against the batch form."""

import datetime as dt
import random

import pandas as pd

from memspark.streaming import jobs, turns
from tests.test_operators import A, B

DDL = "scope_kind string, scope_owner string, turn_key string, ts timestamp, answer string, tool string"
START = dt.datetime(2024, 1, 1, 10)


def requests(n, seed, tools=30):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        at = START + dt.timedelta(microseconds=r.randrange(6 * 3600 * 10**6))
        rows.append((*r.choice([A, B]), r.choice(["k", "l", None]), at, r.choice([None, "", f"a{r.randrange(9**9)}"]), r.choice([None, "", f"t{r.randrange(tools)}"])))
    return rows


def shown(df):
    return sorted(tuple(map(str, row)) for row in df.select("scope_owner", "turn_key", "started", "ended", "n_requests", "answer", "tags").collect())


def run(spark, batches, folder, **options):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{folder}/in/b{i:03d}")
    stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    q = turns.stream_turns(stream, **options).writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    q = q.foreachBatch(jobs.write_batches(f"{folder}/out")).start()
    q.awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out/batch_id=*").drop("batch_id"), q


def test_turns_equal_the_batch_form_in_any_order(spark, tmp_path):
    """Requests come shuffled over three batches, all within the lateness; a closing request ends every turn."""
    rows = requests(150, 1)
    end = (*A, "closing", START + dt.timedelta(days=5), None, None)
    got, _ = run(spark, [rows[:50], rows[50:100], rows[100:], [end]], tmp_path, lateness="1 day")
    assert shown(got) == shown(jobs.agent_turns(spark.createDataFrame(rows, DDL)))


def test_turns_close_while_the_stream_runs(spark, tmp_path):
    """In order, turns leave the state as time goes on; a request for a turn that has left comes too late.

    Spark drops late rows by the watermark of the batch before, so the turn is out one batch earlier."""
    at = lambda m: START + dt.timedelta(minutes=m)
    batches = [[(*A, "k", at(0), None, "read"), (*A, "k", at(5), "x", "grep"), (*A, "none", None, "x", "y")], [(*A, "k", at(14), "done", "read")], [(*A, "k", at(90), "later", None)], [(*B, "k", at(200), None, None)], [(*A, "k", at(1), "late", "late"), (*B, "k", at(300), None, None)]]
    got, q = run(spark, batches, tmp_path)
    assert [r[4:] for r in shown(got.filter("scope_owner = 'user:a'"))] == [("3", "done", "['agent', 'tool:read', 'tool:grep']"), ("1", "later", "[]")]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # the one open turn, its timer and their bookkeeping


def test_a_turn_in_state_keeps_sixteen_tools():
    """State of a turn doesn't grow with its requests; folding part by part equals folding at once."""
    r = random.Random(3)
    rows = pd.DataFrame({"at": [r.randrange(10**9) for _ in range(20_000)], "tool": [f"t{r.randrange(500)}" for _ in range(20_000)]})
    rows["end"], rows["answer"] = rows["at"] + 10**9, [f"a{r.randrange(10**6)}" for _ in range(20_000)]
    folded = []
    for i in range(0, 20_000, 700):
        folded = turns.joined(folded + turns.stretches(rows[i : i + 700]))
        assert all(len(t[5]) <= jobs.MAX_TOOL_TAGS for t in folded)
    assert folded == turns.stretches(rows)
    first = rows.groupby("tool")["at"].min().sort_values(kind="stable").head(16)
    assert folded[0][6] == first.tolist() and folded[0][2] == 20_000


def test_turns_touching_at_their_end_stay_apart():
    turn = lambda a, b: (a, b, 1, None, None, [], [])
    assert turns.joined([turn(10, 20), turn(0, 10)]) == [turn(0, 10), turn(10, 20)]
    assert turns.joined([turn(9, 19), turn(0, 10)])[0][:3] == (0, 19, 2)
