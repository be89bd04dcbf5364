"""Filters and predicates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.functions import timeex as D
from memspark.operators import matching, panels, versions
from memspark.operators.scope import SCOPE, scope_filter_batch, writable_batch
from memspark.operators.search import usable_model, pending_model
from memspark.plans import retrieve
from memspark.registry import query
from memspark.registry.scalars import TF_CTE
from memspark.registry.views import ORDERS_AS_OF, as_of, audit_log, ctes, entities, episodes, facts, queries, summaries


@query("scope_filter", ctes("episodes_v") + """SELECT c.c_custkey AS session_id, count(*) AS n_visible, max(e.ts) AS newest FROM customer c
 JOIN episodes_v e ON e.scope_owner IN ('user:' || c.c_custkey, 'user:' || c.c_nationkey) GROUP BY 1""")
def scope_filter(t):
    """Every customer as a session: acting scope its own, workspace its nation's."""
    s = t.customer.select(
        F.col("c_custkey").alias("session_id"), F.lit("private").alias("acting_kind"), F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("acting_owner"),
        F.lit("private").alias("workspace_kind"), F.concat(F.lit("user:"), F.col("c_nationkey").cast("string")).alias("workspace_owner"),
    )
    # counts per scope first, so a hot scope is one row when it meets its many sessions
    per_scope = episodes(t).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest"))
    seen = scope_filter_batch(per_scope, s)
    return seen.groupBy("session_id").agg(F.sum("n").alias("n_visible"), F.max("newest").alias("newest"))


@query("scope_write_check", ctes("episodes_v") + """SELECT c.c_custkey AS session_id, count(*) AS n_writable FROM customer c
 JOIN episodes_v e ON e.scope_kind = 'private' AND e.scope_owner = 'user:' || c.c_nationkey GROUP BY 1""")
def scope_write_check(t):
    """Rows each session may write: those of its workspace only."""
    s = t.customer.select(
        F.col("c_custkey").alias("session_id"), F.lit("private").alias("workspace_kind"), F.concat(F.lit("user:"), F.col("c_nationkey").cast("string")).alias("workspace_owner")
    )
    per_scope = episodes(t).groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("n_writable"))
    return writable_batch(per_scope, s).select("session_id", "n_writable")


@query("current_versions", ctes("current_v") + "SELECT id, scope_owner, period, version FROM current_v")
def current_versions(t):
    return versions.current_versions(summaries(t)).select("id", "scope_owner", "period", "version")


@query("current_period_head", ctes("current_v") + """SELECT id, scope_owner, level, period, created_at FROM current_v
 QUALIFY row_number() OVER (PARTITION BY scope_kind, scope_owner, level, period ORDER BY created_at DESC, id DESC) = 1""")
def current_period_head(t):
    return versions.current_period_head(summaries(t)).select("id", "scope_owner", "level", "period", "created_at")


@query("unexpired", ctes("facts_v") + f"SELECT id, expires_at FROM facts_v WHERE expires_at IS NULL OR expires_at >= DATE '{ORDERS_AS_OF}' - 400")
def unexpired(t):
    now = F.date_sub(F.lit(ORDERS_AS_OF).cast("date"), 400)
    return panels.unexpired(facts(t), now).select("id", "expires_at")


_MODELS = "CASE vec_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'old:a' ELSE 'new:b' END"


def with_models(t):
    m = F.col("vec_id") % 4
    return t.embeddings.select("vec_id", "label", "embedding", F.when(m == 0, None).when(m == 1, "old:a").otherwise("new:b").alias("embedding_model"))


@query("embedding_model_filter", f"""WITH e AS (SELECT vec_id, {_MODELS} AS embedding_model FROM embeddings)
SELECT vec_id, embedding_model IS NULL OR embedding_model = 'new:b' AS searchable, embedding_model IS DISTINCT FROM 'new:b' AS pending FROM e""")
def embedding_model_filter(t):
    e = with_models(t)
    use = usable_model(e, "new:b").select("vec_id", F.lit(True).alias("searchable"))
    todo = pending_model(e, "new:b").select("vec_id", F.lit(True).alias("pending"))
    return use.join(todo, "vec_id", "full_outer").select("vec_id", F.coalesce("searchable", F.lit(False)).alias("searchable"), F.coalesce("pending", F.lit(False)).alias("pending"))


@query("timeframe_filter", ctes("queries_v", "episodes_v", more=TF_CTE) + """, d AS (SELECT ts::DATE AS day, event_type, count(*) AS n FROM episodes_v GROUP BY ALL),
 c AS (SELECT query_id, event_type, d.day, n, tf_start IS NULL OR (d.day >= tf_start AND d.day < tf_end) AS inside FROM tf_v CROSS JOIN d),
 b AS (SELECT *, bool_or(inside) OVER (PARTITION BY query_id) AS any_inside FROM c)
SELECT query_id, event_type, sum(n)::BIGINT AS n_kept FROM b WHERE inside OR NOT any_inside GROUP BY query_id, event_type""")
def timeframe_filter(t):
    """Day counts of events inside each query's timeframe; a timeframe without events is ignored.

    Queries share a handful of timeframes and days: both meet as (timeframe, day) rows, never as
    query times event.
    """
    tf = D.resolve_timeframe(F.col("text"), as_of())
    q = queries(t).select("query_id", tf.alias("tf")).withColumn("frame", F.concat_ws("..", F.col("tf.start").cast("string"), F.col("tf.end").cast("string")))
    days = episodes(t).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    frames = q.filter("tf is not null").select("tf", "frame").distinct()
    inside = frames.withColumn("day", F.explode(F.sequence(F.col("tf.start"), F.date_sub(F.col("tf.end"), 1)))).join(days, "day")
    inside = inside.groupBy("frame", "event_type").agg(F.sum("n").alias("n_kept"))
    filled = inside.select("frame").distinct().withColumn("hit", F.lit(True))
    whole = days.groupBy("event_type").agg(F.sum("n").alias("n_kept")).select(F.lit("all").alias("frame"), "event_type", "n_kept")
    q = q.join(filled, "frame", "left").withColumn("frame", F.when(F.col("hit"), F.col("frame")).otherwise("all"))
    return q.join(inside.unionByName(whole), "frame").select("query_id", "event_type", "n_kept")


@query("entity_overlap_narrow", ctes("current_v") + """SELECT id FROM current_v WHERE list_has_any(entities_touched,
 (SELECT list('part:' || p_partkey) FROM part WHERE p_brand = 'Brand#7'))""")
def entity_overlap_narrow(t):
    """Current summaries that touch a matched entity, as a semi join on the exploded ids."""
    wanted = t.part.filter("p_brand = 'Brand#7'").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("entity_id"))
    return matching.touching(versions.current_versions(summaries(t)), wanted, keys=[]).select("id")


@query("entity_list", ctes("place_entities_v") + """SELECT id, name, kind, rank FROM (SELECT *, row_number() OVER (ORDER BY last_updated DESC, name, id)::INTEGER AS rank
 FROM (SELECT *, DATE '2024-01-01' + (strlen(id) * 3)::INTEGER AS last_updated FROM place_entities_v WHERE kind = 'person' AND contains(lower(name), '0_1'))) WHERE rank <= 51
 UNION ALL SELECT id, name, kind, rank FROM (SELECT *, row_number() OVER (ORDER BY last_updated DESC, name, id)::INTEGER AS rank
 FROM (SELECT *, DATE '2024-01-01' + (strlen(id) * 3)::INTEGER AS last_updated FROM place_entities_v WHERE kind = 'place' AND contains(lower(name), 'n_1'))) WHERE rank <= 51""")
def entity_list(t):
    """The pattern sign ``_`` in the filter is plain text."""
    from memspark.registry.views import place_entities

    e = place_entities(t).withColumn("last_updated", F.date_add(F.lit("2024-01-01").cast("date"), F.octet_length("id") * 3))
    a = matching.entity_list(e, kind="person", name_contains="0_1", limit=50)
    b = matching.entity_list(e, kind="place", name_contains=" N_1 ", limit=50)
    return a.unionByName(b).select("id", "name", "kind", "rank")


_LOOK = """l AS (SELECT n_nationkey AS lookup_id, CASE n_nationkey % 4 WHEN 0 THEN 'place:n' || n_nationkey WHEN 1 THEN lower(n_name) WHEN 2 THEN ' ' || substr(n_name, 4) || ' ' ELSE 'nowhere_' END AS wanted FROM nation
 UNION ALL SELECT 1000 + s_suppkey, substr(s_name, 8) FROM supplier),
 e AS (SELECT *, DATE '2024-01-01' + strlen(name)::INTEGER AS last_updated FROM place_entities_v),
 h AS (SELECT lookup_id, e.id, CASE WHEN e.id = trim(wanted) THEN 1 WHEN lower(e.name) = lower(trim(wanted)) THEN 2 ELSE 3 END AS tier, e.last_updated FROM l JOIN e
 ON e.id = trim(wanted) OR lower(e.name) = lower(trim(wanted)) OR contains(lower(e.name), lower(trim(wanted))) OR contains(lower(e.id), lower(trim(wanted)))),
 b AS (SELECT *, min(tier) OVER (PARTITION BY lookup_id) AS best FROM h),
 r AS (SELECT *, row_number() OVER (PARTITION BY lookup_id ORDER BY last_updated DESC, id)::INTEGER AS rank FROM b WHERE tier = best)"""


@query("entity_lookup", ctes("place_entities_v", more=_LOOK) + """SELECT lookup_id, id, tier, rank, count(*) OVER (PARTITION BY lookup_id) AS n_matches FROM r WHERE rank <= 6""")
def entity_lookup(t):
    from memspark.registry.views import place_entities

    e = place_entities(t).withColumn("last_updated", F.date_add(F.lit("2024-01-01").cast("date"), F.octet_length("name")))
    m = F.col("n_nationkey") % 4
    wanted = (
        F.when(m == 0, F.concat(F.lit("place:n"), F.col("n_nationkey").cast("string"))).when(m == 1, F.lower("n_name"))
        .when(m == 2, F.concat(F.lit(" "), F.substring("n_name", 4, 100), F.lit(" "))).otherwise("nowhere_")
    )
    a = t.nation.select(F.col("n_nationkey").cast("long").alias("lookup_id"), wanted.alias("wanted"))
    b = t.supplier.select((F.col("s_suppkey") + 1000).alias("lookup_id"), F.substring("s_name", 8, 100).alias("wanted"))
    look = a.unionByName(b).select(F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner"), "lookup_id", "wanted")
    return matching.entity_lookup(e, look).select("lookup_id", "id", "tier", "rank", "n_matches")


@query("audit_query", ctes("audit_v") + """SELECT id, ts, event_type, actor FROM audit_v WHERE event_type = 'export' AND (target_ref::JSON ->> '$.k') = '9'
 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-28' ORDER BY ts DESC, id DESC LIMIT 100""")
def audit_query(t):
    return panels.audit_query(
        audit_log(t), event_type="export", target_id="9", target_path="$.k", since=F.lit("2024-01-05").cast("timestamp_ntz"),
        until=F.lit("2024-01-28").cast("timestamp_ntz"), limit=100,
    ).select("id", "ts", "event_type", "actor")


@query("security_events", ctes("audit_v") + """SELECT id, scope_owner, event_type FROM (SELECT *, row_number() OVER (PARTITION BY scope_kind, scope_owner ORDER BY ts DESC, id DESC) AS r FROM audit_v
 WHERE event_type IN ('export', 'import', 'key_rotation', 'correct', 'dashboard_login')) WHERE r <= 20""")
def security_events(t):
    return panels.security_events(audit_log(t), limit=20).select("id", "scope_owner", "event_type")


_ROTATED = """ro AS (SELECT scope_kind, scope_owner, min(id) AS a, max(id) AS b FROM audit_v WHERE event_type = 'key_rotation' GROUP BY ALL),
 n AS (SELECT scope_kind, scope_owner, count(*) AS n_events FROM audit_v WHERE event_type IN ('export', 'import', 'key_rotation', 'correct', 'dashboard_login') GROUP BY ALL)"""


@query("key_rotation_status", ctes("audit_v", more=_ROTATED) + """SELECT coalesce(ro.scope_owner, n.scope_owner) AS scope_owner, CASE WHEN a % 2 = 0 THEN 'completed' WHEN a IS NOT NULL THEN 'running' END AS status, a AS from_version, a + 1 AS to_version, coalesce(n_events, 0) AS n_events
 FROM ro FULL OUTER JOIN n ON ro.scope_kind = n.scope_kind AND ro.scope_owner = n.scope_owner""")
def key_rotation_status(t):
    """The first rotation of each scope as its status, beside its security-relevant events."""
    a = audit_log(t)
    r = a.filter("event_type = 'key_rotation'").groupBy("scope_kind", "scope_owner").agg(F.min("id").alias("from_version"), F.min("ts").alias("started_at"))
    r = r.withColumn("to_version", F.col("from_version") + 1).withColumn("status", F.when(F.col("from_version") % 2 == 0, "completed").otherwise("running"))
    r = r.withColumn("completed_at", F.when(F.col("status") == "completed", F.col("started_at")))
    return panels.key_rotation_status(a, r).select("scope_owner", "status", "from_version", "to_version", "n_events")


@query("clamp_params", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 = 0 OR l_partkey % 90 = 0 THEN 20 ELSE least(l_partkey % 90, 50) END AS n FROM lineitem")
def clamp_params(t):
    """Asked page sizes, every fourth missing: 20 by default, 50 at most."""
    asked = F.when(F.col("l_suppkey") % 4 != 0, F.col("l_partkey") % 90)
    return t.lineitem.select("l_orderkey", "l_linenumber", panels.clamped(asked, 20, 50).cast("long").alias("n"))


_GATE = """e AS (SELECT q.query_id, count(n.id) AS n_hits FROM queries_v q LEFT JOIN entities_v n ON contains(lower(q.text), lower(n.name)) OR (substr(n.id, instr(n.id, ':') + 1) <> '' AND contains(lower(q.text), substr(n.id, instr(n.id, ':') + 1))) GROUP BY q.query_id)"""


def _gate_sql():
    from memspark.registry.scalars import SIGNAL_SQL

    return ctes("queries_v", "entities_v", more=_GATE) + f"""SELECT q.query_id, n_hits, CASE WHEN n_hits > 0 THEN 'full' WHEN {SIGNAL_SQL} THEN 'partial' ELSE 'skipped' END AS gate FROM queries_v q JOIN e ON e.query_id = q.query_id"""


@query("memory_gate", _gate_sql())
def memory_gate(t):
    q = queries(t)
    hits = matching.stage1_entity_match(q, entities(t)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"))
    n = F.coalesce("n_hits", F.lit(0).cast("long"))
    gate = retrieve.memory_gate((n > 0) | X.search_signal(F.col("text")), n > 0)
    return q.join(hits, "query_id", "left").select("query_id", n.alias("n_hits"), gate.alias("gate"))
