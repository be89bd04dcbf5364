"""Walks, maps and topic clusters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.operators import graph, joins, panels
from memspark.operators.scope import SCOPE
from memspark.registry import query
from memspark.registry.aggregates import TOPICS_SQL, all_topics, topics
from memspark.registry.joins import _MENT, chat_memory, entities_per_scope
from memspark.registry.views import ctes, place_edges, vectors

_WALK = """b AS (SELECT subject_id AS a, object_id AS z FROM place_edges_v UNION SELECT object_id, subject_id FROM place_edges_v),
 h1 AS (SELECT * FROM (SELECT 'person:' || c_custkey AS seed, z AS id, row_number() OVER (PARTITION BY c_custkey ORDER BY z) AS r FROM customer JOIN b ON a = 'person:' || c_custkey) WHERE r <= 10),
 h2 AS (SELECT * FROM (SELECT seed, z AS id, row_number() OVER (PARTITION BY seed ORDER BY z) AS r FROM (SELECT DISTINCT h1.seed, b.z FROM h1 JOIN b ON b.a = h1.id WHERE b.z <> h1.seed AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.seed = h1.seed AND x.id = b.z))) WHERE r <= 10),
 al AS (SELECT seed, id, 1 AS hop FROM h1 UNION ALL SELECT seed, id, 2 FROM h2)"""


@query("graph_walk", ctes("place_edges_v", more=_WALK) + "SELECT seed, id, hop::INTEGER AS hop FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, id) AS n FROM al) WHERE n <= 10")
def graph_walk(t):
    """From every customer over nation hubs."""
    s = t.customer.select(F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner"), F.col("c_custkey").alias("query_id"), F.concat(F.lit("person:"), F.col("c_custkey").cast("string")).alias("id"))
    w = graph.graph_walk(place_edges(t), s)
    return w.select(F.concat(F.lit("person:"), F.col("query_id").cast("string")).alias("seed"), "id", "hop")


_MAP = _MENT + """, cn AS (SELECT conv_id, 'conversation:' || id AS node_id, 'conversation' AS type FROM ep),
 me AS (SELECT split_part(episode_id, '_', 2)::BIGINT AS conv_id, * FROM mm)"""


def map_parts(t):
    ep, sm = chat_memory(t)
    ments = joins.conversation_mentions(ep, sm, entities_per_scope(t, sm))
    conv = ep.select(*SCOPE, F.col("id").alias("episode_id"), F.lit("2024-01-01 10:00:00").cast("timestamp_ntz").alias("ts"))
    first = ments.groupBy(*SCOPE, "episode_id").agg(F.min(F.struct("entity_id", "entity_name", "entity_kind")).alias("a"), F.max(F.struct("entity_id", "entity_name", "entity_kind")).alias("b"))
    rels = first.filter("a.entity_id <> b.entity_id").select(
        *SCOPE, F.col("episode_id").alias("edge_no"), F.col("a.entity_id").alias("subject_id"), F.col("a.entity_name").alias("subject_name"),
        F.col("b.entity_id").alias("object_id"), F.col("b.entity_name").alias("object_name"),
    )
    return graph.memory_map_graph(conv, rels, ments)


@query("memory_map_nodes", ctes("entities_v", more=_MAP) + """SELECT 'user:' || conv_id AS scope_owner, node_id, type, '2024-01-01 10:00' AS label FROM cn
UNION ALL SELECT DISTINCT 'user:' || conv_id, 'entity:' || entity_id, 'entity', entity_name FROM me""")
def memory_map_nodes(t):
    return map_parts(t)[0].select("scope_owner", "node_id", "type", "label")


@query("memory_map_graph", ctes("entities_v", more=_MAP) + """SELECT 'user:' || conv_id AS scope_owner, 'mentions:' || episode_id || ':' || entity_id AS edge_id, 'conversation:' || episode_id AS source, 'entity:' || entity_id AS target FROM me
UNION ALL SELECT 'user:' || conv_id, 'relationship:' || episode_id, 'entity:' || min(entity_id), 'entity:' || max(entity_id) FROM me GROUP BY conv_id, episode_id HAVING min(entity_id) <> max(entity_id)""")
def memory_map_graph(t):
    return map_parts(t)[1].select("scope_owner", "edge_id", "source", "target")


@query("topic_graph", f"WITH {TOPICS_SQL} SELECT 'conversation:' || conv_id || '_' || turn AS source, 'topic:' || tq.term AS target, tq.n FROM tq JOIN tg ON tg.term = tq.term")
def topic_graph(t):
    tp = topics(t).withColumn("conv", F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")))
    return panels.topic_graph(tp, panels.global_topics(all_topics(t)), "conv").select("source", "target", "n")


DAYS = 3
SIM = 0.30


def sources(t):
    """Vectors of one label as the sources of a scope, spread over a few days."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % DAYS).cast("int"))
    return vectors(t).withColumn("day", day)


_CL = f"""v AS (SELECT vec_id, label, vec_id % {DAYS} AS d, embedding::DOUBLE[] AS e FROM embeddings),
 ed AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.d = b.d AND a.vec_id <> b.vec_id WHERE round(list_cosine_similarity(a.e, b.e), 6) >= {SIM}),
 cc AS (SELECT vec_id AS n, vec_id AS r FROM v UNION SELECT ed.y, cc.r FROM cc JOIN ed ON ed.x = cc.n)"""


@query("topic_clusters", f"WITH RECURSIVE {_CL} SELECT n AS id, min(r) AS cluster FROM cc GROUP BY n")
def topic_clusters(t):
    return graph.topic_clusters(sources(t), sim=SIM, min_sources=1).select("id", "cluster")


@query("cluster_cap")
def cluster_cap(t):
    s = sources(t)
    c = graph.topic_clusters(s, sim=SIM, min_sources=graph.CLUSTER_MIN_SOURCES)
    return graph.cluster_cap(s, c, dimensions=64).select("scope_owner", "day", "id", "cluster")
