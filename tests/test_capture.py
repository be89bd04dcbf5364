"""The capture sink that looks only into the folders of its own keys."""

import datetime as dt
import os

from pyspark.sql import functions as F

from memspark.streaming import jobs
from tests.test_operators import A, B

DDL = "scope_kind string, scope_owner string, id string, ts timestamp, input_text string, output_text string"
KEYS = ["scope_kind", "scope_owner", "id"]
START = dt.datetime(2024, 1, 1, 12)


def made(day, n):
    at = START + dt.timedelta(days=day)
    return f"ep_{int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000):013d}{n:020d}", at


def feed(spark, path, batches, seen=None):
    write = jobs.write_new(path, KEYS, part=jobs.id_day(F.col("id")))
    for i, rows in enumerate(batches):
        write(jobs.capture(spark.createDataFrame(rows, DDL)), i)


def stored(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("scope_owner", "id", "ts", "input_text").collect()), key=str)


def size(folders):
    return sum(os.path.getsize(os.path.join(d, f)) for p in folders for d, _, fs in os.walk(p.removeprefix("file:")) for f in fs if f.endswith(".parquet"))


def test_a_batch_reads_only_its_own_days(spark, tmp_path, monkeypatch):
    """Twelve daily batches: what is looked into stays as large as one day; late rows and repeats of old days are right."""
    looked, find = [], jobs.part_folders

    def spy(*args):
        found = find(*args)
        looked.append((len(found), size(found)))
        return found

    monkeypatch.setattr(jobs, "part_folders", spy)
    batches, want = [], set()
    for day in range(12):
        (one, at), (other, _), (back, _) = made(day, 1), made(day, 2), made(max(day - 1, 0), 1)
        rows = [(*A, one, at, "first", "x"), (*A, one, at + dt.timedelta(seconds=5), "again", "x"), (*B, other, at, "b", "y")]
        rows.append((*A, back, at + dt.timedelta(hours=9), "repeat of the day before, with another time", "x"))
        want |= {(A[1], one, "first"), (B[1], other, "b")}
        batches.append(rows)
    (late, at), (old, _) = made(2, 77), made(0, 1)
    batches.append([(*A, late, at, "late", "x"), (*A, old, at, "repeat", "x"), (*B, old, at, "another scope", "x"), (*A, "no clock", at, "n", "x"), (*A, None, at, "null id", "x")])
    batches.append([(*A, "no clock", at, "again", "x"), (*A, late, at, "again", "x")])
    want |= {(A[1], late, "late"), (B[1], old, "another scope"), (A[1], "no clock", "n"), (A[1], None, "null id")}
    path = str(tmp_path / "out")
    feed(spark, path, batches)
    got = stored(spark, path)
    assert len(got) == len(want) and {(g[0], g[1], g[3]) for g in got} == want
    assert [n for n, _ in looked] == [0, *[1] * 11, 2, 2]
    assert looked[11][1] <= 1.1 * looked[1][1]


def test_a_batch_of_many_days_and_a_repeated_batch(spark, tmp_path, monkeypatch):
    """Over more days than are named, all folders are looked into; a batch that runs again replaces itself."""
    monkeypatch.setattr(jobs, "MOST_PARTS", 2)
    rows = [(*A, *made(day, 1), "first", "x") for day in range(5)]
    again = [(*r[:4], "again", "x") for r in rows] + [(*A, *made(9, 1), "new", "x")]
    path = str(tmp_path / "out")
    feed(spark, path, [rows, again])
    want = stored(spark, path)
    assert [w[3] for w in want].count("first") == 5 and [w[3] for w in want].count("new") == 1 and len(want) == 6
    feed(spark, path, [rows, again])
    assert stored(spark, path) == want
