"""Dashboard panels and per-scope counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import theme_tokens
from memspark.operators.running import running_totals, top_per_key
from memspark.operators.scope import SCOPE
from memspark.operators.versions import current_versions

# Panel limits.
NARROW_ABOVE, DISABLE_ABOVE = 500, 3000
FORGOTTEN_IMPORTANCE, STALE_DAYS = 0.7, 30
TOPICS_PER_CONVERSATION, GLOBAL_TOPICS, MIN_TOPIC_COUNT = 5, 30, 2
SECURITY_EVENTS = ["export", "import", "key_rotation", "correct", "dashboard_login"]


def search_tier(total: Column, narrow: int = NARROW_ABOVE, disable: int = DISABLE_ABOVE) -> Column:
    """How keyword search is limited for a corpus of this size; an unknown corpus is searched in full."""
    return F.when(total > disable, F.lit("disabled")).when(total > narrow, F.lit("narrowed")).otherwise(F.lit("full"))


def interactions(episodes: DataFrame) -> DataFrame:
    return episodes.filter(F.col("type") == "interaction")


def conversation_volume(episodes: DataFrame, *, as_of: Column, days: int) -> DataFrame:
    """Interactions per scope and day over the last ``days`` days."""
    recent = interactions(episodes).filter(F.col("ts") >= as_of - F.expr(f"INTERVAL {int(days)} DAYS"))
    return recent.groupBy(*SCOPE, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def theme_cloud(summaries: DataFrame, entities: DataFrame, *, limit: int, name_keys: list[str] | None = None) -> DataFrame:
    """Most mentioned entities of each scope's current summaries. ``name_keys``: what names join by (scope and id)."""
    touched = current_versions(summaries).select(*SCOPE, F.explode("entities_touched").alias("id"))
    counted = touched.groupBy(*SCOPE, "id").agg(F.count(F.lit(1)).alias("mentions"))
    by = name_keys or [*SCOPE, "id"]
    named = counted.join(entities.select(*by, "name"), by)
    return top_per_key(named, SCOPE, [F.col("mentions").desc(), F.col("name"), F.col("id")], limit)


def corpus_size(episodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Interactions and current summaries per scope."""
    e = interactions(episodes).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("episode_count"))
    s = current_versions(summaries).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("summary_count"))
    zero = F.lit(0).cast("long")
    return e.join(s, SCOPE, "full_outer").select(
        *SCOPE, F.coalesce("episode_count", zero).alias("episode_count"), F.coalesce("summary_count", zero).alias("summary_count")
    )


def memory_health(episodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Corpus counts, time of the last summary and number of corrected versions per scope."""
    history = summaries.groupBy(*SCOPE).agg(
        F.max("created_at").alias("last_summary_at"), F.count("correction_reason").alias("corrections_count")
    )
    return corpus_size(episodes, summaries).join(history, SCOPE, "left").withColumn(
        "corrections_count", F.coalesce("corrections_count", F.lit(0).cast("long"))
    )


def unconsolidated_count(episodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Interactions after the day of the scope's latest daily summary; all of them without one."""
    latest = summaries.filter(F.col("level") == "daily").groupBy(*SCOPE).agg(F.max("period").alias("_latest"))
    days = interactions(episodes).groupBy(*SCOPE, F.to_date("ts").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    after = F.col("_latest").isNull() | (F.col("_day") > F.try_to_date("_latest", "yyyy-MM-dd"))
    return days.join(latest, SCOPE, "left").groupBy(*SCOPE).agg(F.sum(F.when(after, F.col("_n")).otherwise(0)).alias("unconsolidated"))


def forgotten_episodes(episodes: DataFrame, *, as_of: Column, limit: int, importance: float = FORGOTTEN_IMPORTANCE, days: int = STALE_DAYS) -> DataFrame:
    old = interactions(episodes).filter((F.col("importance") >= importance) & (F.col("ts") < as_of - F.expr(f"INTERVAL {int(days)} DAYS")))
    return top_per_key(old, SCOPE, [F.col("importance").desc(), F.col("ts").desc(), F.col("id")], limit)


def stale_entities(entities: DataFrame, *, as_of: Column, limit: int, days: int = STALE_DAYS) -> DataFrame:
    old = entities.filter(F.col("last_updated") < F.date_sub(F.to_date(as_of), days))
    return top_per_key(old, SCOPE, [F.col("last_updated"), F.col("id")], limit)


def conversations_in_range(episodes: DataFrame, *, start: Column, end: Column, limit: int) -> DataFrame:
    """Newest interactions of each scope inside [start, end)."""
    rows = interactions(episodes).filter((F.col("ts") >= start) & (F.col("ts") < end))
    return top_per_key(rows, SCOPE, [F.col("ts").desc(), F.col("id").desc()], limit)


def relationship_latest(edges: DataFrame, *, limit: int) -> DataFrame:
    return top_per_key(edges, SCOPE, [F.col("created_at").desc(), F.col("id").desc()], limit)


def recent_summaries(summaries: DataFrame, facts: DataFrame, *, since: str, as_of: Column, limit: int = 7) -> DataFrame:
    """Newest current daily summaries per scope since a day, with their live facts joined in order."""
    rows = current_versions(summaries).filter((F.col("level") == "daily") & (F.col("period") >= since))
    top = top_per_key(rows, SCOPE, [F.col("period").desc(), F.col("id").desc()], limit, "rank")
    return top.join(key_facts_of(facts, as_of), [*SCOPE, "id"], "left")


def key_facts_of(facts: DataFrame, as_of: Column) -> DataFrame:
    """Grounded, unexpired facts of each summary as one ordered array; a summary's facts are few."""
    live = unexpired(facts.filter("grounded"), as_of)
    row = F.struct(F.col("id").alias("fact_id"), "fact")
    return live.groupBy(*SCOPE, F.col("summary_id").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("key_facts"))


def unexpired(facts: DataFrame, as_of: Column) -> DataFrame:
    return facts.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= F.to_date(as_of)))


def budget_prefix(texts: DataFrame, keys: list[str], *, bucket: Column, order: list[Column], cap: int, per_item: int) -> DataFrame:
    """Newest-first texts, each cut to ``per_item`` characters, until ``cap`` characters are reached.

    The text that crosses the cap is kept. Adds ``chars_before``.
    """
    cut = texts.withColumn("text", F.substring("text", 1, per_item))
    run = running_totals(cut, keys, bucket, order, F.length("text"), "chars_before", descending=True)
    return run.filter(F.col("chars_before") < cap)


def term_counts(texts: DataFrame, keys: list[str]) -> DataFrame:
    """How often each key's texts hold each theme term: keys, term, n."""
    terms = texts.select(*keys, F.explode(theme_tokens(F.col("text"))).alias("term"))
    return terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def term_frequency(texts: DataFrame, keys: list[str], *, top: int) -> DataFrame:
    """Most frequent theme terms per key: keys, term, n."""
    return top_per_key(term_counts(texts, keys), keys, [F.col("n").desc(), F.col("term")], top)


def global_topics(topics: DataFrame, *, top: int = GLOBAL_TOPICS, at_least: int = MIN_TOPIC_COUNT, keys: list[str] = SCOPE) -> DataFrame:
    """Terms over all conversations of a scope by summed count; the rare ones go after the cut.

    ``topics`` are ``term_counts``, not a cut of them, so every mention counts.
    """
    total = topics.groupBy(*keys, "term").agg(F.sum("n").alias("n"))
    return top_per_key(total, keys, [F.col("n").desc(), F.col("term")], top).filter(F.col("n") >= at_least)


def topic_graph(topics: DataFrame, kept: DataFrame, conversation: str, keys: list[str] = SCOPE) -> DataFrame:
    """Links from conversations to the topics that stayed."""
    rows = topics.join(kept.select(*keys, "term"), [*keys, "term"], "left_semi")
    return rows.select(
        *keys, F.concat(F.lit("conversation:"), F.col(conversation).cast("string")).alias("source"), F.concat(F.lit("topic:"), "term").alias("target"), "n"
    )


def audit_query(
    audit: DataFrame, *, scope_kind: str = "", scope_owner: str = "", actor: str = "", event_type: str = "", target_id: str = "",
    target_path: str = "$.id", since: Column | None = None, until: Column | None = None, ascending: bool = False, limit: int | None = None,
) -> DataFrame:
    """Audit rows that meet every given condition, newest first unless ``ascending``."""
    rows = audit
    for column, value in (("scope_kind", scope_kind), ("scope_owner", scope_owner), ("actor", actor), ("event_type", event_type)):
        if value:
            rows = rows.filter(F.col(column) == value)
    if target_id:
        rows = rows.filter(F.get_json_object("target_ref", target_path) == target_id)
    if since is not None:
        rows = rows.filter(F.col("ts") >= since)
    if until is not None:
        rows = rows.filter(F.col("ts") < until)
    order = [F.col("ts").asc(), F.col("id").asc()] if ascending else [F.col("ts").desc(), F.col("id").desc()]
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def security_events(audit: DataFrame, *, limit: int) -> DataFrame:
    """The latest ``limit`` security-relevant rows of each scope."""
    rows = audit.filter(F.col("event_type").isin(SECURITY_EVENTS))
    return top_per_key(rows, SCOPE, [F.col("ts").desc(), F.col("id").desc()], limit)


def key_rotation_status(events: DataFrame, rotations: DataFrame) -> DataFrame:
    """Per scope with either, its key rotation (from_version, to_version, status, started_at, completed_at; null
    without one) and how many security-relevant events it has."""
    n = events.filter(F.col("event_type").isin(SECURITY_EVENTS)).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_events"))
    cols = ["from_version", "to_version", "status", "started_at", "completed_at"]
    rows = rotations.select(*SCOPE, *cols).join(n, SCOPE, "full_outer")
    return rows.withColumn("n_events", F.coalesce("n_events", F.lit(0).cast("long")))


def status_counters(rows: DataFrame, by: str, columns: list[str] | None = None) -> DataFrame:
    """Outcome counts per scope, one column per outcome."""
    return rows.groupBy(*SCOPE).pivot(by, columns).agg(F.count(F.lit(1))).na.fill(0)


def truncated(counts: Column, limit: int) -> Column:
    return counts >= limit


def shown(counts: Column, limit: int) -> Column:
    """How many of ``counts`` rows a page of ``limit`` shows."""
    return F.least(counts, F.lit(limit).cast("long"))


def clamp(value: int | None, default: int, largest: int) -> int:
    """A caller's limit: the default when missing or not positive, never above the largest."""
    return default if not value or value <= 0 else min(value, largest)


def clamped(value: Column, default: int, largest: int) -> Column:
    """``clamp`` for a column of limits."""
    return F.when(value.isNull() | (value <= 0), F.lit(default)).otherwise(F.least(value, F.lit(largest)))
