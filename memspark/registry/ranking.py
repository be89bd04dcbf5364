"""Top-k searches, fusion, diversity and ordered selections over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.operators import bm25, fusion, panels, search, versions
from memspark.operators.scope import SCOPE
from memspark.registry import query
from memspark.registry.aggregates import BM25_SQL, FACT_SQL, _PAIRS, doc_facts
from memspark.registry.scalars import label_sql
from memspark.session import materialize
from memspark.registry.views import (
    as_of, benchmark_queries, corpus_docs, ctes, entities, episodes, facts, preference_edges, summaries, vectors,
)


def self_queries(t, **cols):
    v = vectors(t)
    q = v.select(*SCOPE, F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("id").alias("self_id"))
    for name, c in cols.items():
        q = q.withColumn(name, c)
    return q


@query("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, doc_id, score, (rank - 1)::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5")
def bm25_topk(t):
    return bm25.bm25_topk(corpus_docs(t), benchmark_queries(t), k=5).select("query_id", "doc_id", "score", "rank")


VEC_SQL = f"""{_PAIRS}, x AS (SELECT query_id, id, sim FROM p WHERE query_id <> id)"""


@query("vector_topk", f"WITH {VEC_SQL} SELECT query_id, id, sim, (rank - 1)::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM x) WHERE rank <= 15")
def vector_topk(t):
    """Every vector searches its own label, itself left out."""
    return search.vector_topk(vectors(t), self_queries(t), k=15, exclude_self=True).select("query_id", "id", "sim", "rank")


@query("vector_topk_all", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 x AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT query_id, id, sim, (rank - 1)::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM x) WHERE rank <= 5""")
def vector_topk_all(t):
    """One scope that holds every vector: the hottest possible key."""
    one = [F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner")]
    v = t.embeddings.select(*one, F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = t.embeddings.select(*one, F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("vec_id").alias("self_id"))
    return search.vector_topk(v, q, k=5, exclude_self=True).select("query_id", "id", "sim", "rank")


@query("vector_topk_approx", f"WITH {VEC_SQL} SELECT query_id, id, sim, (rank - 1)::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM x) WHERE rank <= 5")
def vector_topk_approx(t):
    """The pruned search gives the exact rows."""
    return search.vector_topk_pruned(vectors(t), self_queries(t), k=5, anchors=8, exclude_self=True).select("query_id", "id", "sim", "rank")


@query("similarity_cutoff", f"WITH {VEC_SQL} SELECT query_id, id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM x WHERE sim >= CASE WHEN query_id % 2 = 0 THEN 0.25 ELSE 0.40 END) WHERE rank <= CASE WHEN query_id % 2 = 0 THEN 10 ELSE 5 END")
def similarity_cutoff(t):
    """Thresholds and result counts per query: even ones search wider."""
    wide = F.col("id") % 2 == 0
    v = vectors(t)
    q = v.select(
        *SCOPE, F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("id").alias("self_id"),
        F.when(wide, search.WIDENED_SIMILARITY).otherwise(search.SUMMARY_SIMILARITY).alias("threshold"),
        F.when(wide, search.WIDENED_ENTITIES).otherwise(search.TOP_K).alias("k"),
    )
    return search.vector_topk(v, q, k=search.WIDENED_ENTITIES, exclude_self=True).select("query_id", "id", "sim")


# three rankings of one label's vectors: by cosine, by id distance, by block
RRF_SQL = f"""{VEC_SQL}, c1 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) - 1 AS r FROM x),
 c2 AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY sim, id) - 1 AS r FROM x),
 g AS (SELECT query_id, 's' || (id // 7) AS grp, max(sim) AS sim FROM p GROUP BY ALL),
 c3 AS (SELECT query_id, grp, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, grp) - 1 AS r FROM g),
 u AS (SELECT query_id, 's' || (id // 7) AS grp, min(r) FILTER (k = 1) AS r1, min(r) FILTER (k = 2) AS r2 FROM (SELECT *, 1 AS k FROM c1 WHERE r < 15 UNION ALL SELECT *, 2 FROM c2 WHERE r < 15) GROUP BY ALL),
 m AS (SELECT coalesce(u.query_id, c3.query_id) AS query_id, coalesce(u.grp, c3.grp) AS id, r1, r2, c3.r AS r3 FROM u FULL JOIN (SELECT * FROM c3 WHERE r < 15) c3 ON u.query_id = c3.query_id AND u.grp = c3.grp)"""


def rrf_channels(t):
    v = vectors(t)
    neg = F.transform("query_vector", lambda x: -x)
    near = search.vector_topk(v, self_queries(t), k=15, exclude_self=True)
    far = search.vector_topk(v, self_queries(t).withColumn("query_vector", neg), k=15, exclude_self=True)
    group = F.concat(F.lit("s"), F.floor(F.col("id") / 7).cast("string"))

    def grouped(hits):
        return hits.groupBy(*SCOPE, "query_id", group.alias("id")).agg(F.min("rank").alias("rank"))

    f = v.select(*SCOPE, group.alias("summary_id"), "vector")
    fact = search.fact_channel(f, self_queries(t), k=15)
    return {"vector": grouped(near), "keyword": grouped(far), "fact": fact}


@query("rrf_fuse", f"WITH {RRF_SQL} SELECT query_id, id, r1::INTEGER AS vector_rank, r2::INTEGER AS keyword_rank, r3::INTEGER AS fact_rank, round(coalesce(1.0::DOUBLE / (r1 + 2), 0) + coalesce(1.0::DOUBLE / (r2 + 2), 0) + coalesce(1.0::DOUBLE / (r3 + 2), 0), 6) AS fused FROM m")
def rrf_fuse(t):
    """Nearest vectors, farthest vectors and nearest groups as three channels."""
    fused = fusion.rrf_fuse(rrf_channels(t))
    return fused.select("query_id", "id", "vector_rank", "keyword_rank", "fact_rank", F.round("fused", 6).alias("fused"))


@query("candidate_union", f"WITH {RRF_SQL} SELECT query_id, id FROM m")
def candidate_union(t):
    ch = rrf_channels(t)
    return search.candidate_union(*ch.values()).select("query_id", "id")


@query("exclude_found", f"WITH {RRF_SQL} SELECT query_id, id FROM m WHERE r1 IS NULL AND r3 IS NOT NULL")
def exclude_found(t):
    ch = rrf_channels(t)
    return search.exclude_found(ch["fact"], ch["vector"]).select("query_id", "id")


@query("rerank_apply", f"""WITH {RRF_SQL}, f AS (SELECT query_id, id, round(coalesce(1.0::DOUBLE / (r1 + 2), 0) + coalesce(1.0::DOUBLE / (r2 + 2), 0) + coalesce(1.0::DOUBLE / (r3 + 2), 0), 6) AS fused, r1 FROM m)
SELECT query_id, id, CASE WHEN query_id % 2 = 0 AND r1 IS NOT NULL AND count(*) OVER (PARTITION BY query_id) > 1 THEN 10.0 - r1 ELSE fused END::DOUBLE AS relevance FROM f""")
def rerank_apply(t):
    """Scores given for the vector channel's candidates; even queries ask for an order."""
    fused = fusion.rrf_fuse(rrf_channels(t))
    pool = fused.select(*SCOPE, "query_id", "id", F.round("fused", 6).alias("relevance"), (F.col("query_id") % 2 == 0).alias("is_ordering"))
    scores = fused.filter("vector_rank is not null").select(*SCOPE, "query_id", "id", (10.0 - F.col("vector_rank")).alias("score"))
    return fusion.rerank_apply(pool, scores).select("query_id", "id", "relevance")


def mmr_pool(t):
    """Benchmark texts with the documents keyword search finds, three times as many as are picked."""
    docs = corpus_docs(t)
    hits = materialize(bm25.bm25_topk(docs, benchmark_queries(t), k=15), "hits")
    found = docs.join(hits.select(*SCOPE, "doc_id").distinct(), [*SCOPE, "doc_id"], "left_semi")
    toks = found.select(*SCOPE, "doc_id", X.token_set(F.col("text")).alias("tokens"))
    return hits.join(toks, [*SCOPE, "doc_id"]).select(
        *SCOPE, "query_id", F.col("doc_id").alias("id"), fusion.reciprocal_rank(F.col("rank")).alias("relevance"), "tokens"
    )


_MMR = f"""WITH RECURSIVE {BM25_SQL}, h AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 15),
 pool AS (SELECT query_id, h.doc_id AS id, 1.0::DOUBLE / (rank + 1) AS rel, list_distinct(terms) AS toks FROM h JOIN d ON h.doc_id = d.doc_id),
 sim AS (SELECT a.query_id, a.id, b.id AS other, len(list_intersect(a.toks, b.toks))::DOUBLE / len(list_distinct(list_concat(a.toks, b.toks))) AS j FROM pool a JOIN pool b ON a.query_id = b.query_id AND a.id <> b.id),
 st AS (SELECT query_id, 0 AS step, []::BIGINT[] AS picked FROM pool GROUP BY query_id UNION ALL
  SELECT query_id, step + 1, list_append(picked, id) FROM (SELECT st.query_id, st.step, st.picked, pool.id,
   row_number() OVER (PARTITION BY st.query_id ORDER BY 0.7::DOUBLE * pool.rel - (1 - 0.7::DOUBLE) * coalesce((SELECT max(j) FROM sim WHERE sim.query_id = st.query_id AND sim.id = pool.id AND list_contains(st.picked, sim.other)), 0.0) DESC, pool.id) AS r
   FROM st JOIN pool ON st.query_id = pool.query_id WHERE st.step < 5 AND NOT list_contains(st.picked, pool.id)) WHERE r = 1)
SELECT query_id, unnest(picked) AS id, (unnest(range(1, 6)) - 1)::INTEGER AS pick FROM st WHERE step = 5"""


@query("mmr_select", _MMR)
def mmr_select(t):
    return fusion.mmr_select(mmr_pool(t), k=5).select("query_id", "id", "pick")


RANK_SQL = f"""{FACT_SQL},
 fr AS (SELECT fl.summary_id, fl.fact_id, fl.text, score, 1 + fl.fact_id % 3 AS source_count, len(fq.terms) > 0 AS asks,
  CASE WHEN len(list_distinct(fl.terms)) = 0 THEN NULL ELSE round(CASE WHEN len(fq.terms) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(fl.terms), list_distinct(fq.terms))) / len(list_distinct(list_concat(fl.terms, fq.terms))) END, 6) END AS sim
  FROM fl JOIN fq ON fl.summary_id = fq.summary_id),
 o1 AS (SELECT *, CASE WHEN asks THEN score ELSE 0 END AS ls, bool_and(sim IS NOT NULL) OVER (PARTITION BY summary_id) AS semantic,
  row_number() OVER (PARTITION BY summary_id ORDER BY CASE WHEN asks THEN score ELSE 0 END DESC, CASE WHEN asks THEN source_count ELSE 0 END DESC, fact_id) - 1 AS lex,
  row_number() OVER (PARTITION BY summary_id ORDER BY sim DESC NULLS LAST, fact_id) - 1 AS sem FROM fr),
 o2 AS (SELECT *, CASE WHEN semantic THEN round(1.0::DOUBLE / (lex + 2) + 1.0::DOUBLE / (sem + 2), 9) END AS fused FROM o1),
 o3 AS (SELECT *, row_number() OVER (PARTITION BY summary_id ORDER BY fused DESC NULLS LAST, CASE WHEN semantic THEN source_count ELSE 0 END DESC, CASE WHEN semantic THEN 0 ELSE lex END, fact_id) - 1 AS fact_rank FROM o2),
 o4 AS (SELECT *, lead(CASE WHEN semantic THEN fused ELSE ls END) OVER (PARTITION BY summary_id ORDER BY fact_rank) AS nxt FROM o3),
 o5 AS (SELECT summary_id, fact_id, text, fact_rank::INTEGER AS fact_rank, fact_rank = 0 AND coalesce(CASE WHEN semantic THEN round(fused - nxt, 9) >= 0.1 ELSE asks AND ls > 0 AND round(ls - nxt, 9) > 0 END, FALSE) AS most_relevant FROM o4)"""


def ranked_facts(t):
    f, q = doc_facts(t)
    terms = f.join(q.select("summary_id", X.token_set(F.col("text")).alias("qt")), "summary_id").withColumn("ft", X.token_set(F.col("text")))
    sim = F.when(F.size("ft") > 0, F.round(X.jaccard(F.col("ft"), F.col("qt")), 6))
    rows = terms.select("summary_id", "fact_id", "text", sim.alias("similarity"), (F.col("fact_id") % 3 + 1).alias("source_count"))
    return fusion.keyfact_rank(rows, q, ["summary_id"])


@query("keyfact_rank", ctes("sentences_v", more=RANK_SQL) + "SELECT summary_id, fact_id, fact_rank FROM o5")
def keyfact_rank(t):
    """Similarity is the token overlap with the asking line; a fact without tokens has none."""
    return ranked_facts(t).select("summary_id", "fact_id", "fact_rank")


@query("keyfact_marker", ctes("sentences_v", more=RANK_SQL) + "SELECT summary_id, fact_id FROM o5 WHERE most_relevant")
def keyfact_marker(t):
    return ranked_facts(t).filter("most_relevant").select("summary_id", "fact_id")


def packed_facts(t):
    """Documents with their ranked facts as one array."""
    row = F.struct("fact_rank", "fact_id", "text", "most_relevant")
    packed = ranked_facts(t).groupBy("summary_id").agg(F.collect_list(row).alias("facts"))
    docs = t.documents.select(F.concat(F.lit("sum_"), F.col("doc_id").cast("string")).alias("summary_id"), "text")
    none = F.array().cast(packed.schema["facts"].dataType)
    return docs.join(packed, "summary_id", "left").withColumn("facts", F.coalesce("facts", none))


_PROSE = "CASE WHEN length(d.text) > {n} THEN substr(d.text, 1, {n}) || chr(10) || '...[truncated to fit context budget]' ELSE d.text END"


@query("keyfact_guarantee", ctes("sentences_v", more=RANK_SQL) + f"""SELECT 'sum_' || doc_id AS summary_id, md5(chr(10) || 'related memory (summary sum_' || doc_id || '): ' || substr(CASE WHEN n IS NULL THEN {_PROSE.format(n=300)} WHEN n <= 3 THEN joined ELSE first END, 1,
 greatest(220 - strlen(chr(10) || 'related memory (summary sum_' || doc_id || '): '), 60))) AS line
 FROM documents d LEFT JOIN (SELECT summary_id, count(*) AS n, string_agg(text, ' ' ORDER BY fact_id) AS joined, arg_min(text, fact_rank) AS first FROM o5 GROUP BY 1) g ON g.summary_id = 'sum_' || d.doc_id""")
def keyfact_guarantee(t):
    p = packed_facts(t)
    prefix = F.concat(F.lit("\nrelated memory (summary "), "summary_id", F.lit("): "))
    line = fusion.guarantee_line(prefix, F.col("text"), F.col("facts"), fusion.guarantee_share(F.lit(5)))
    return p.select("summary_id", F.md5(line).alias("line"))


@query("depth_text", ctes("sentences_v", more=RANK_SQL) + f"""SELECT 'sum_' || doc_id AS summary_id, md5(substr(coalesce(lines, '') || chr(10) || {_PROSE.format(n=500)}, 1, 700)) AS block FROM documents d LEFT JOIN
 (SELECT summary_id, string_agg(chr(10) || '  - ' || CASE WHEN most_relevant THEN '(most relevant) ' ELSE '' END || text, '' ORDER BY fact_rank) AS lines FROM o5 GROUP BY 1) g ON g.summary_id = 'sum_' || d.doc_id""")
def depth_text(t):
    return packed_facts(t).select("summary_id", F.md5(fusion.depth_text(F.col("text"), F.col("facts"))).alias("block"))


@query("recent_summaries", ctes("current_v", "facts_v") + """, r AS (SELECT *, row_number() OVER (PARTITION BY scope_owner ORDER BY period DESC, id DESC)::INTEGER AS rank FROM current_v WHERE period >= '1998-01-01')
SELECT r.scope_owner, r.id, r.period, r.rank, f.fact FROM r LEFT JOIN facts_v f ON f.summary_id = r.id AND f.grounded AND (f.expires_at IS NULL OR f.expires_at >= DATE '2000-01-01') WHERE r.rank <= 7""")
def recent_summaries(t):
    now = F.lit("2000-01-01").cast("date")
    r = panels.recent_summaries(summaries(t), facts(t), since="1998-01-01", as_of=now, limit=7)
    return r.select("scope_owner", "id", "period", "rank", F.explode_outer("key_facts.fact").alias("fact"))


@query("conversations_in_range", ctes("episodes_v") + """SELECT id, scope_owner, ts FROM episodes_v WHERE type = 'interaction' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25'
 QUALIFY row_number() OVER (PARTITION BY scope_owner ORDER BY ts DESC, id DESC) <= 10""")
def conversations_in_range(t):
    day = lambda d: F.lit(d).cast("timestamp_ntz")
    return panels.conversations_in_range(episodes(t), start=day("2024-01-05"), end=day("2024-01-25"), limit=10).select("id", "scope_owner", "ts")


@query("relationship_latest", ctes("prefs_v") + "SELECT subject_id, object_id, valid_from FROM prefs_v ORDER BY valid_from DESC, order_no DESC LIMIT 200")
def relationship_latest(t):
    e = preference_edges(t).withColumn("created_at", F.col("valid_from")).withColumn("id", F.col("order_no"))
    return panels.relationship_latest(e, limit=200).select("subject_id", "object_id", "valid_from")


@query("forgotten_important", ctes("episodes_v", "entities_v") + """SELECT 'episode' AS what, id FROM (SELECT id FROM episodes_v WHERE type = 'interaction' AND importance >= 0.7 AND ts < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 15 DAY
 QUALIFY row_number() OVER (PARTITION BY scope_owner ORDER BY importance DESC, ts DESC, id) <= 3)
UNION ALL SELECT 'entity', id FROM (SELECT id FROM entities_v WHERE last_updated < DATE '2024-01-31' - 15 ORDER BY last_updated, id LIMIT 40)""")
def forgotten_important(t):
    e = panels.forgotten_episodes(episodes(t), as_of=as_of(), limit=3, days=15).select(F.lit("episode").alias("what"), "id")
    s = panels.stale_entities(entities(t), as_of=as_of(), limit=40, days=15).select(F.lit("entity").alias("what"), "id")
    return e.unionByName(s)


@query("budget_prefix", """WITH c AS (SELECT role, conv_id, turn, substr(text, 1, 200) AS cut FROM conversations),
 r AS (SELECT *, coalesce(sum(length(cut)) OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before FROM c)
SELECT role, conv_id, turn, chars_before FROM r WHERE chars_before < 5000""")
def budget_prefix(t):
    """Three hot keys: the running sum over a role goes by conversation first."""
    out = panels.budget_prefix(t.conversations, ["role"], bucket=F.col("conv_id"), order=[F.col("turn").desc()], cap=5000, per_item=200)
    return out.select("role", "conv_id", "turn", "chars_before")


_CLOSE = """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day FROM orders),
 l AS (SELECT *, lead(day) OVER w - day AS gap, lead(day) OVER w AS nxt, lead(o_orderkey) OVER w AS nxt_key FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY day, o_orderkey)),
 b AS (SELECT * FROM l WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY gap, day, o_orderkey) = 1)
"""


def dated_orders(t):
    return t.orders.select("o_custkey", F.col("o_orderkey").alias("fact_id"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("description"), F.to_date("o_orderdate").alias("date"))


@query("closest_date_pair", _CLOSE + "SELECT o_custkey, o_orderkey AS first_id, nxt_key AS second_id, day AS first_date, nxt AS second_date, gap::INTEGER AS gap_days FROM b WHERE gap <= 2")
def closest_date_pair(t):
    from memspark.plans.hints import closest_date_pair as pair

    p = pair(dated_orders(t), ["o_custkey"])
    return p.select("o_custkey", "first_id", "second_id", "first_date", "second_date", "gap_days")


_HINT_TEXT = """'A separate computation over the retrieved facts found a pair of matching events on consecutive days: "order ' || o_orderkey || '" on ' || day || ' and "order ' || nxt_key || '" on ' || nxt || ' (' || gap || ' day(s) apart). As of now, the later of those two was ' || lbl || '. Use this only if it directly answers the question — otherwise ignore it.'"""


@query("aggregation_hint", _CLOSE + f", h AS (SELECT *, {label_sql('nxt::TIMESTAMP', 'TIMESTAMP ' + chr(39) + '2000-03-01' + chr(39), 'ago')} AS lbl FROM b WHERE gap <= 2) SELECT o_custkey, {_HINT_TEXT} AS hint FROM h WHERE lbl <> '' AND o_custkey % 3 <> 2")
def aggregation_hint(t):
    from memspark.plans.hints import aggregation_hint as hint

    k = F.col("o_custkey") % 3
    asked = F.when(k == 0, "Which two orders came In a Row?").when(k == 1, "two orders back to back").otherwise("List my orders from earliest to latest")
    q = t.orders.select("o_custkey", asked.alias("question"))
    return hint(dated_orders(t), ["o_custkey"], F.lit("2000-03-01").cast("timestamp_ntz"), questions=q).select("o_custkey", "hint")


@query("version_chain_order", ctes("summaries_v", recursive=True, more="""k AS (SELECT a.id, a.scope_owner, a.period, b.id AS up FROM summaries_v a LEFT JOIN summaries_v b ON a.supersedes = b.id AND a.scope_owner = b.scope_owner AND a.period = b.period),
 r AS (SELECT id, scope_owner, period, 0 AS depth FROM k WHERE up IS NULL UNION ALL SELECT k.id, k.scope_owner, k.period, depth + 1 FROM k JOIN r ON k.up = r.id)""") + "SELECT id, scope_owner, period, depth::BIGINT AS depth FROM r")
def version_chain_order(t):
    return versions.version_chain_order(summaries(t), [*SCOPE, "level", "period"]).select("id", "scope_owner", "period", "depth")
