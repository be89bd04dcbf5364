"""Streaming capture, turn assembly, counters and limits.

Every stream can be replayed from its source: sinks are keyed by batch id, so a batch that runs
again after a lost executor or driver replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memspark.functions import text as X
from memspark.operators.scope import SCOPE
from memspark.session import scratch_path

# Turn assembly.
TURN_TTL, MAX_TOOL_TAGS = "15 minutes", 16


def capture(turns: DataFrame) -> DataFrame:
    """Turns with importance and hash, to be stored by ``write_new``.

    ``turns``: scope, id, ts, input_text, output_text. Nothing is kept in state, so a turn is stored
    whenever it comes, however late.
    """
    rows = turns.withColumn("importance", X.importance_score(F.col("input_text"), F.col("output_text")))
    return rows.withColumn("hash", X.content_hash(F.col("input_text"), F.col("output_text")))


def write_new(path: str, keys: list[str], order: str = "ts", part: Column | None = None) -> Callable[[DataFrame, int], None]:
    """Sink that stores rows whose ``keys`` no earlier batch has, of repeats in a batch the first by ``order``.

    Only the key columns of stored rows are read; a repeated batch replaces itself. ``part``, an expression over
    the keys alone (the day an id was made, a range of counted ids), deals the stored rows to folders
    ``part=.../batch_id=...``. Equal keys have equal parts, so a batch looks only into the folders of its own keys
    and is right however late a row or its repeat comes; the cost of a batch follows its own parts, not the store.
    A null part is a folder of its own; rows must not have columns named ``part`` or ``batch_id``.
    """

    def first(batch: DataFrame) -> DataFrame:
        others = [c for c in batch.columns if c not in keys]
        return batch.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in others])

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = first(batch)
        if batch_id:
            stored = batch.sparkSession.read.option("basePath", path).parquet(f"{path}/batch_id=*").filter(F.col("batch_id") < batch_id)
            rows = rows.join(stored.select(*keys), keys, "left_anti")
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    def write_parts(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        named = F.coalesce(part.cast("string"), F.lit("none")).alias("part")
        folders = part_folders(spark, path, batch.select(named))
        rows = first(batch).select("*", named)
        if folders:
            types = dict(batch.dtypes)
            schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", part string, batch_id bigint"
            stored = spark.read.schema(schema).option("basePath", path).parquet(*folders).filter(F.col("batch_id") < batch_id)
            # one join key more, so that both sides are dealt alike; null keys are never repeats
            rows = rows.join(stored.select(*keys, "part"), [*keys, "part"], "left_anti")
        out = rows.select(*batch.columns, "part", F.lit(batch_id).cast("bigint").alias("batch_id"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch_id").parquet(path)

    return write if part is None else write_parts


def id_day(episode_id: Column) -> Column:
    """Day on which an episode id was made, from its 13-digit millisecond clock; null for other ids."""
    return F.to_date(F.timestamp_millis(F.regexp_extract(episode_id, r"^ep_(\d{13})", 1).try_cast("bigint")))


#: Folder names that one batch brings to the driver; a batch over more parts looks into all folders.
MOST_PARTS = 1000


def part_folders(spark: SparkSession, path: str, rows: DataFrame) -> list[str]:
    """Stored folders that may hold a key of ``rows``: those of its parts, or all where it has too many parts."""
    parts = [r["part"] for r in rows.select("part").distinct().limit(MOST_PARTS + 1).collect()]
    hadoop_path, escape = spark._jvm.org.apache.hadoop.fs.Path, spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    root = hadoop_path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if len(parts) > MOST_PARTS:
        return [s.getPath().toString() for s in files.globStatus(hadoop_path(f"{path}/part=*")) or []]
    named = [hadoop_path(root, f"part={escape(p)}") for p in parts]
    return [p.toString() for p in named if files.exists(p)]


def agent_turns(requests: DataFrame, *, ttl: str = TURN_TTL, lateness: str = "15 minutes") -> DataFrame:
    """Requests of one turn as one captured row: scope, turn_key, started, ended, n_requests, answer, tags.

    ``requests``: scope, turn_key, ts, answer, tool. A turn ends after ``ttl`` without a request;
    its answer is the last non-empty one, its tags the tools in order of first use.
    """
    final = F.when(F.coalesce("answer", F.lit("")) != "", F.col("answer"))
    used = F.when(F.coalesce("tool", F.lit("")) != "", F.struct(F.col("ts").alias("t"), F.col("tool").alias("n")))
    out = requests.withWatermark("ts", lateness).groupBy(*SCOPE, "turn_key", F.session_window("ts", ttl).alias("w")).agg(
        F.count(F.lit(1)).alias("n_requests"), F.max_by(final, F.when(final.isNotNull(), F.col("ts"))).alias("answer"), F.array_sort(F.collect_list(used)).alias("_used")
    )
    names = F.slice(F.array_distinct(F.transform("_used", lambda u: u["n"])), 1, MAX_TOOL_TAGS)
    tags = F.transform(names, lambda n: F.concat(F.lit("tool:"), n))
    none = F.array().cast("array<string>")
    return out.select(
        *SCOPE, "turn_key", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_requests", "answer",
        F.when(F.size(tags) > 0, F.concat(F.array(F.lit("agent")), tags)).otherwise(none).alias("tags"),
    )


def open_turns(requests: DataFrame, closed: DataFrame, *, ttl: str = TURN_TTL) -> DataFrame:
    """Turns the stream has not closed yet, from the stored ``requests`` after each key's last closed turn."""
    last = closed.groupBy(*SCOPE, "turn_key").agg(F.max("ended").alias("_ended"))
    rest = requests.join(last, [*SCOPE, "turn_key"], "left").filter(F.col("_ended").isNull() | (F.col("ts") >= F.col("_ended"))).drop("_ended")
    return agent_turns(rest, ttl=ttl)


def daily_volume(episodes: DataFrame, *, lateness: str = "1 day") -> DataFrame:
    """Interactions per scope and day in tumbling windows, for update mode."""
    live = episodes.filter(F.col("type") == "interaction").withWatermark("ts", lateness)
    n = live.groupBy(*SCOPE, F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*SCOPE, F.to_date("w.start").alias("day"), "n")


def window_counts(events: DataFrame, keys: list[str], *, width: str, step: str, lateness: str = "1 hour") -> DataFrame:
    """Counts per key in sliding windows: keys, window_end, n."""
    c = events.withWatermark("ts", lateness).groupBy(*keys, F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return c.select(*keys, F.col("w.end").alias("window_end"), "n")


def over_cap(counts: DataFrame, cap: int) -> DataFrame:
    return counts.withColumn("over_cap", F.col("n") > cap)


def rate_limit(events: DataFrame, keys: list[str], *, seconds: int, limit: int, tie: str) -> DataFrame:
    """Batch form: each event with the events of its key in the window before it and ``allowed``.

    Denied events count too. A hot key is cut into time buckets of the window's width; each bucket
    also sees copies of the previous bucket's rows, which is all a window can reach into.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    width = seconds * 1_000_000
    rows = events.withColumn("_us", micros).withColumn("_own", F.floor(micros / width))
    spread = rows.select("*", F.explode(F.array("_own", F.col("_own") + 1)).alias("_bucket"))
    # strictly younger than the window's edge; rows of one instant count in tie order
    near = W.partitionBy(*keys, "_bucket").orderBy("_us").rangeBetween(-(width - 1), 0)
    same = W.partitionBy(*keys, "_bucket", "_us").orderBy(tie)
    out = spread.withColumn("_peers", F.count(F.lit(1)).over(W.partitionBy(*keys, "_bucket", "_us")))
    out = out.withColumn("n", F.count(F.lit(1)).over(near) - F.col("_peers") + F.row_number().over(same))
    return out.filter("_bucket = _own").withColumn("allowed", F.col("n") <= limit).drop("_us", "_own", "_bucket", "_peers")


def audit_tail(audit: DataFrame, *, last: int) -> DataFrame:
    """The newest ``last`` rows, oldest first."""
    return audit.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(last).orderBy("ts", "id")


def live_rows(df: DataFrame, as_of: Column, column: str = "expires_at") -> DataFrame:
    """Rows that have not expired at reading time."""
    return df.filter(F.col(column).isNull() | (F.col(column) >= as_of))


def write_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that stores every batch under its own id; a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def latest_by_key(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """State of an update-mode stream stored by ``write_batches``: the newest row of every key."""
    from pyspark.sql import types as T

    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    rows = spark.read.schema(full).option("basePath", path).parquet(f"{path}/batch_id=*")
    others = [f.name for f in schema.fields if f.name not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def run_available(df: DataFrame, name: str, *, mode: str = "append", new_by: list[str] | None = None, part: Column | None = None) -> tuple[str, StreamingQuery]:
    """Run a stream over everything its source has now and wait; returns the sink folder.

    ``new_by``: keys of which only the first row is stored, ``part``: see ``write_new``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    query = (
        df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/_state").trigger(availableNow=True)
        .foreachBatch(write_new(f"{path}/out", new_by, part=part) if new_by else write_batches(f"{path}/out")).start()
    )
    query.awaitTermination()
    return f"{path}/out", query


def corpus_counter(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink that keeps counts per scope: every batch stores its own additions.

    The table is the sum over batches, so a repeated batch changes nothing.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        kind = F.col("type") == "interaction"
        n = batch.groupBy(*SCOPE).agg(F.count(F.when(kind, 1)).alias("episode_count"), F.max("ts").alias("updated_at"))
        n.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return add


def corpus_table(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("scope_kind string, scope_owner string, episode_count bigint, updated_at timestamp").option("basePath", path).parquet(f"{path}/batch_id=*")
    return rows.groupBy(*SCOPE).agg(F.sum("episode_count").alias("episode_count"), F.max("updated_at").alias("updated_at"))
