"""Streams over the given event files, run to the end; answers must equal the batch ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.operators.scope import SCOPE
from memspark.registry import Tables, query
from memspark.registry.views import as_of, audit_log, ctes, episodes
from memspark.session import scratch_path
from memspark.streaming import jobs
from memspark.streaming.turns import stream_turns


class StreamTables(Tables):
    """The same tables, read as file streams with the schema of the stored file."""

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        schema = self.spark.read.parquet(self.path(name)).schema
        return self.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)


def stream(t):
    return StreamTables(t.spark, t.sf_dir)


def clocked(df):
    """Event time as an instant, which watermarks need."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_capture", ctes("episodes_v") + "SELECT id, scope_owner, ts, 'sha256:' || sha256(event_type || chr(0) || props) AS hash FROM episodes_v")
def stream_capture(t):
    """Every event comes twice and is stored once; ids are counted up, so thousands of one range lie in a folder."""
    e = clocked(episodes(stream(t))).select(*SCOPE, "id", "ts", F.col("event_type").alias("input_text"), F.col("props").alias("output_text"))
    twice = e.withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    counted = F.floor(F.regexp_extract("id", r"(\d+)$", 1).try_cast("bigint") / 4096)
    path, _ = jobs.run_available(jobs.capture(twice), "capture", new_by=[*SCOPE, "id"], part=counted)
    out = t.spark.read.option("basePath", path).parquet(f"{path}/part=*")
    return out.select("id", "scope_owner", F.col("ts").cast("timestamp_ntz").alias("ts"), "hash")


_TURNS = """g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 6 * 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS fresh FROM episodes_v WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)"""


_TURN_SQL = ctes("episodes_v", more=_TURNS) + """SELECT scope_owner, min(ts) AS started, count(*) AS n_requests, arg_max(props, ts) FILTER (event_type <> 'view') AS answer,
 CASE WHEN count(*) FILTER (event_type IN ('click', 'purchase')) = 0 THEN '' WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'agent,tool:click' WHEN count(*) FILTER (event_type = 'click') = 0 THEN 'agent,tool:purchase'
 WHEN min(ts) FILTER (event_type = 'click') < min(ts) FILTER (event_type = 'purchase') THEN 'agent,tool:click,tool:purchase' ELSE 'agent,tool:purchase,tool:click' END AS tags FROM s GROUP BY scope_owner, user_id, sid"""


def requests_of(events):
    tool = F.when(F.col("event_type").isin("click", "purchase"), F.col("event_type"))
    return events.select(*SCOPE, F.col("user_id").cast("string").alias("turn_key"), "ts", F.when(F.col("event_type") != "view", F.col("props")).alias("answer"), tool.alias("tool"))


def shown_turns(turns):
    return turns.select("scope_owner", F.col("started").cast("timestamp_ntz").alias("started"), "n_requests", "answer", F.array_join("tags", ",").alias("tags"))


@query("stream_agent_turns", _TURN_SQL)
def stream_agent_turns(t):
    """A user's events with gaps under six hours are one turn; those still open at the end come from the source."""
    path, _ = jobs.run_available(stream_turns(requests_of(clocked(episodes(stream(t)))), ttl="6 hours"), "turns")
    closed = t.spark.read.option("basePath", path).parquet(f"{path}/batch_id=*").drop("batch_id")
    still = jobs.open_turns(requests_of(clocked(episodes(t))), closed, ttl="6 hours")
    return shown_turns(closed.unionByName(still))


@query("agent_turns", _TURN_SQL)
def agent_turns(t):
    """The batch form over the same rows."""
    return shown_turns(jobs.agent_turns(requests_of(clocked(episodes(t))), ttl="6 hours"))


@query("stream_daily_volume", ctes("episodes_v") + "SELECT scope_owner, ts::DATE AS day, count(*) AS n FROM episodes_v WHERE type = 'interaction' GROUP BY ALL")
def stream_daily_volume(t):
    v = jobs.daily_volume(clocked(episodes(stream(t))))
    path, _ = jobs.run_available(v, "volume", mode="update")
    return jobs.latest_by_key(t.spark, path, v.schema, [*SCOPE, "day"]).drop("scope_kind")


@query("stream_daily_cap", """SELECT window_end, count(*) AS n, count(*) > 400 AS over_cap FROM (SELECT unnest([date_trunc('day', ts) + INTERVAL 12 HOUR * CASE WHEN hour(ts) >= 12 THEN 2 ELSE 1 END, date_trunc('day', ts) + INTERVAL 12 HOUR * CASE WHEN hour(ts) >= 12 THEN 3 ELSE 2 END]) AS window_end FROM events WHERE event_type = 'signup') GROUP BY 1""")
def stream_daily_cap(t):
    """Sign-ups as created sessions in windows of a day that slide by half a day."""
    e = clocked(stream(t).events).filter("event_type = 'signup'")
    v = jobs.window_counts(e, [], width="1 day", step="12 hours")
    path, _ = jobs.run_available(v, "cap", mode="update")
    out = jobs.over_cap(jobs.latest_by_key(t.spark, path, v.schema, ["window_end"]), 400)
    return out.select(F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n", "over_cap")


@query("stream_rate_limit", """SELECT event_id, n, n <= 3 AS allowed FROM (SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id)) AND b.ts > a.ts - INTERVAL 24 HOUR GROUP BY 1)""")
def stream_rate_limit(t):
    return jobs.rate_limit(t.events, ["user_id"], seconds=86400, limit=3, tie="event_id").select("event_id", "n", "allowed")


@query("stream_audit_tail", ctes("audit_v") + "SELECT id, ts, event_type, actor FROM audit_v ORDER BY ts DESC, id DESC LIMIT 200")
def stream_audit_tail(t):
    """Audit rows appended by a stream, the newest two hundred shown oldest first."""
    a = audit_log(stream(t)).select("id", "ts", "event_type", "actor")
    path, _ = jobs.run_available(a, "audit")
    return jobs.audit_tail(t.spark.read.option("basePath", path).parquet(f"{path}/batch_id=*").drop("batch_id"), last=200)


@query("stream_corpus_size", ctes("episodes_v") + "SELECT scope_owner, count(*) FILTER (type = 'interaction') AS episode_count, max(ts) AS updated_at FROM episodes_v GROUP BY 1")
def stream_corpus_size(t):
    path = scratch_path(t.spark, "corpus")
    e = clocked(episodes(stream(t)))
    q = e.writeStream.option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).foreachBatch(jobs.corpus_counter(f"{path}/out")).start()
    q.awaitTermination()
    c = jobs.corpus_table(t.spark, f"{path}/out")
    return c.select("scope_owner", "episode_count", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@query("stream_expiry", "SELECT event_id, ts + to_days((1 + event_id % 20)::INTEGER) AS expires_at FROM events WHERE ts + to_days((1 + event_id % 20)::INTEGER) >= TIMESTAMP '2024-01-31 12:00:00'")
def stream_expiry(t):
    """Sessions with a time to live, stored by a stream and filtered when read."""
    life = F.make_dt_interval((F.col("event_id") % 20 + 1).cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(18,6)"))
    s = stream(t).events.select("event_id", (F.col("ts") + life).alias("expires_at"))
    path, _ = jobs.run_available(s, "expiry")
    return jobs.live_rows(t.spark.read.option("basePath", path).parquet(f"{path}/batch_id=*").drop("batch_id"), as_of()).select("event_id", "expires_at")
