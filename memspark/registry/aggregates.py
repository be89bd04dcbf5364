"""Counts, statistics and aggregates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.operators import bm25, panels, search, versions
from memspark.operators.fusion import fact_lexical_scores
from memspark.operators.scope import SCOPE
from memspark.registry import query
from memspark.registry.filters import _MODELS, with_models
from memspark.registry.views import (
    AS_OF, as_of, audit_log, benchmark_queries, corpus_docs, ctes, episodes, facts, sentences, sql_tokens, summaries, vectors,
)

TOK = sql_tokens("text", X.STOP_WORDS)


def lang_docs(t):
    return t.documents.select(F.lit("private").alias("scope_kind"), F.concat(F.lit("user:"), "lang").alias("scope_owner"), "doc_id", "text")


@query("conversation_volume", ctes("episodes_v") + f"""SELECT scope_owner, ts::DATE AS day, count(*) AS n FROM episodes_v
 WHERE type = 'interaction' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY GROUP BY ALL""")
def conversation_volume(t):
    return panels.conversation_volume(episodes(t), as_of=as_of(), days=14).select("scope_owner", "day", "n")


@query("theme_cloud", ctes("current_v") + """, m AS (SELECT scope_owner, id, count(*) AS mentions FROM (SELECT scope_owner, unnest(entities_touched) AS id FROM current_v) GROUP BY ALL),
 n AS (SELECT 'part:' || p_partkey AS id, p_name AS name FROM part UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier)
SELECT scope_owner, id, name, mentions FROM m JOIN n USING (id) QUALIFY row_number() OVER (PARTITION BY scope_owner ORDER BY mentions DESC, name, id) <= 5""")
def theme_cloud(t):
    names = t.part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name")).unionByName(
        t.supplier.select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name")))
    return panels.theme_cloud(summaries(t), names, limit=5, name_keys=["id"]).select("scope_owner", "id", "name", "mentions")


_SIZE = """, e AS (SELECT scope_owner, count(*) AS n FROM episodes_v WHERE type = 'interaction' GROUP BY 1),
 s AS (SELECT scope_owner, count(*) AS n FROM current_v GROUP BY 1),
 z AS (SELECT coalesce(e.scope_owner, s.scope_owner) AS scope_owner, coalesce(e.n, 0) AS episode_count, coalesce(s.n, 0) AS summary_count FROM e FULL JOIN s ON e.scope_owner = s.scope_owner)"""


@query("corpus_size", ctes("episodes_v", "current_v") + _SIZE + " SELECT * FROM z")
def corpus_size(t):
    return panels.corpus_size(episodes(t), summaries(t)).drop("scope_kind")


@query("memory_health", ctes("episodes_v", "current_v") + _SIZE + """ SELECT z.*, last_summary_at, coalesce(corrections_count, 0) AS corrections_count FROM z
 LEFT JOIN (SELECT scope_owner, max(created_at) AS last_summary_at, count(correction_reason) AS corrections_count FROM summaries_v GROUP BY 1) h ON z.scope_owner = h.scope_owner""")
def memory_health(t):
    return panels.memory_health(episodes(t), summaries(t)).drop("scope_kind")


@query("unconsolidated_count", ctes("episodes_v") + """, l AS (SELECT scope_owner, max(strftime(ts, '%Y-%m-%d')) AS latest FROM episodes_v WHERE type = 'note' GROUP BY 1)
SELECT e.scope_owner, sum(CASE WHEN latest IS NULL OR e.ts::DATE > latest::DATE THEN 1 ELSE 0 END)::BIGINT AS unconsolidated FROM episodes_v e LEFT JOIN l ON e.scope_owner = l.scope_owner
 WHERE e.type = 'interaction' GROUP BY 1""")
def unconsolidated_count(t):
    """Notes play the daily summaries."""
    e = episodes(t)
    daily = e.filter("type = 'note'").select(*SCOPE, F.lit("daily").alias("level"), F.date_format("ts", "yyyy-MM-dd").alias("period"))
    return panels.unconsolidated_count(e, daily).drop("scope_kind")


@query("bm25_stats", f"""WITH d AS (SELECT 'user:' || lang AS scope_owner, doc_id, {TOK} AS terms FROM documents),
 c AS (SELECT scope_owner, count(*) AS n_docs, avg(len(terms)) AS avg_len FROM d GROUP BY 1),
 f AS (SELECT scope_owner, term, count(*) AS df FROM (SELECT scope_owner, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL)
SELECT f.scope_owner, term, df, n_docs, round(avg_len, 6) AS avg_len FROM f JOIN c ON f.scope_owner = c.scope_owner""")
def bm25_stats(t):
    return bm25.bm25_stats(lang_docs(t)).select("scope_owner", "term", "df", "n_docs", F.round("avg_len", 6).alias("avg_len"))


BM25_SQL = f"""d AS (SELECT doc_id, {TOK} AS terms FROM documents), c AS (SELECT count(*) AS n, avg(len(terms)) AS al FROM d),
 p AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM d) GROUP BY ALL),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) GROUP BY ALL),
 w AS (SELECT doc_id, p.term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al)) AS weight
  FROM p JOIN f ON p.term = f.term CROSS JOIN c),
 s AS (SELECT query_id, doc_id, round(sum(times * weight), 6) AS score FROM q JOIN w ON q.term = w.term GROUP BY ALL)"""


@query("bm25_score", f"WITH {BM25_SQL} SELECT query_id, count(*) AS n_docs, max(score) AS best FROM s GROUP BY 1")
def bm25_score(t):
    """Scores of every document a query matches, told as count and best per query."""
    terms = bm25.query_terms(benchmark_queries(t))
    posts = bm25.matching_postings(bm25.doc_tokens(corpus_docs(t)), terms)
    best = bm25.bm25_topk(corpus_docs(t), benchmark_queries(t), k=1).select("query_id", F.col("score").alias("best"))
    # matched documents per query from distinct term sets: documents grouped by the terms they hold
    n = matched_documents(posts, terms)
    return n.join(best, "query_id")


def matched_documents(postings, terms):
    """Documents that hold at least one term of a query, counted without query-document pairs.

    A cell counts the union of its terms' documents; blocks of documents do not overlap, so sums of
    cell counts are whole counts.
    """
    from memspark.operators import kernels
    from memspark.operators.cells import cut_into_cells, match_cells

    left, right, cell = cut_into_cells(postings, terms, SCOPE, ["doc_id"], ["query_id"], bm25.POSTINGS_PER_CELL, bm25.TERMS_PER_CELL)
    hits = match_cells(left, right, cell, kernels.count_matches(), "query_id long, n long")
    return hits.groupBy("query_id").agg(F.sum("n").alias("n_docs"))


def doc_facts(t):
    """Every document is a digest: its first line asks, its other lines are the facts."""
    s = sentences(t)
    f = s.filter("pos > 0").select("summary_id", "fact_id", F.col("fact").alias("text"))
    q = s.filter("pos = 0").select("summary_id", F.col("fact").alias("text"))
    return f, q


FACT_SQL = f"""fa AS (SELECT summary_id, fact_id, {sql_tokens('fact', X.STOP_WORDS)} AS terms, fact AS text FROM sentences_v WHERE pos > 0),
 fq AS (SELECT summary_id, {sql_tokens('fact', X.STOP_WORDS)} AS terms FROM sentences_v WHERE pos = 0),
 ft AS (SELECT summary_id, fact_id, term, count(*) AS tf FROM (SELECT summary_id, fact_id, unnest(terms) AS term FROM fa) GROUP BY ALL),
 fd AS (SELECT summary_id, term, count(*) AS df FROM ft GROUP BY ALL), fn AS (SELECT summary_id, count(*) AS n FROM fa GROUP BY 1),
 qt AS (SELECT summary_id, term, count(*) AS times FROM (SELECT summary_id, unnest(terms) AS term FROM fq) GROUP BY ALL),
 fs AS (SELECT ft.summary_id, fact_id, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE)) AS score
  FROM ft JOIN qt ON ft.summary_id = qt.summary_id AND ft.term = qt.term JOIN fd ON ft.summary_id = fd.summary_id AND ft.term = fd.term JOIN fn ON fn.summary_id = ft.summary_id GROUP BY ALL),
 fl AS (SELECT fa.summary_id, fa.fact_id, fa.text, fa.terms, round(coalesce(score, 0.0), 9) AS score FROM fa LEFT JOIN fs ON fa.summary_id = fs.summary_id AND fa.fact_id = fs.fact_id)"""


@query("bm25_no_length_norm", ctes("sentences_v", more=FACT_SQL) + "SELECT summary_id, fact_id, round(score, 6) AS score FROM fl")
def bm25_no_length_norm(t):
    f, q = doc_facts(t)
    return fact_lexical_scores(f, q, ["summary_id"]).select("summary_id", "fact_id", F.round("score", 6).alias("score"))


_PAIRS = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
 p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label, round(list_cosine_similarity(a.e, b.e), 6) AS sim FROM v a JOIN v b ON a.label = b.label)"""


@query("fact_channel_distance", f"""WITH {_PAIRS}, g AS (SELECT query_id, 's' || (id // 7) AS id, max(sim) AS sim FROM p GROUP BY ALL)
SELECT query_id, id, sim, (rank - 1)::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM g) WHERE rank <= 15""")
def fact_channel_distance(t):
    """Vectors as facts of summaries of seven, every vector a query of its label."""
    v = vectors(t)
    f = v.select(*SCOPE, F.concat(F.lit("s"), F.floor(F.col("id") / 7).cast("string")).alias("summary_id"), "vector")
    q = v.select(*SCOPE, F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return search.fact_channel(f, q, k=15).select("query_id", "id", "sim", "rank")


@query("best_over_paraphrases", f"""WITH {_PAIRS}, r AS (SELECT query_id // 3 AS q, query_id AS variant, label, id, sim FROM p),
 k AS (SELECT q, variant, label, id, sim FROM r WHERE sim >= 0.1 QUALIFY row_number() OVER (PARTITION BY label, variant ORDER BY sim DESC, id) <= 5),
 b AS (SELECT label, q, id, max(sim) AS sim FROM k GROUP BY ALL)
SELECT 'user:' || label AS scope_owner, q AS query_id, id, sim, (row_number() OVER (PARTITION BY label, q ORDER BY sim DESC, id) - 1)::INTEGER AS rank FROM b""")
def best_over_paraphrases(t):
    v = vectors(t)
    q = v.select(*SCOPE, F.floor(F.col("id") / 3).alias("query_id"), F.col("id").alias("variant"), F.col("vector").alias("query_vector"))
    return search.best_over_paraphrases(v, q, k=5, threshold=0.1).select("scope_owner", "query_id", "id", "sim", "rank")


_MEM = """m AS (SELECT *, 'part:' || (part % 50) AS entity_id, CASE state WHEN 'F' THEN 'supplier' ELSE 'quantity' END || (version % 3) AS attribute_key,
 CASE state WHEN 'F' THEN 's' || supp ELSE 'q' || qty::INTEGER END AS content, flag <> 'R' AS g FROM summaries_v),
 h AS (SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.supersedes = a.id AND b.scope_owner = a.scope_owner)
  QUALIFY row_number() OVER (PARTITION BY scope_owner, entity_id, attribute_key ORDER BY order_no DESC, version DESC) = 1)"""


def memories(t):
    """Digest versions as attribute rows of entities; versions of one line supersede each other."""
    s = summaries(t)
    key = F.concat(F.when(F.col("state") == "F", "supplier").otherwise("quantity"), (F.col("version") % 3).cast("string"))
    content = F.when(F.col("state") == "F", F.concat(F.lit("s"), F.col("supp").cast("string"))).otherwise(F.concat(F.lit("q"), F.col("qty").cast("int").cast("string")))
    m = s.select(
        "id", *SCOPE, F.concat(F.lit("part:"), (F.col("part") % 50).cast("string")).alias("entity_id"), key.alias("attribute_key"), content.alias("content"),
        (F.col("flag") != "R").alias("grounded"), F.lit(True).alias("is_static"), "supersedes", "order_no", "version",
    )
    return m


#: Many lines are about the same attribute, so a key has several heads; the newest order's stands.
NEWEST = ["order_no", "version"]


@query("current_attribute_heads", ctes("summaries_v", more=_MEM) + "SELECT scope_owner, entity_id, attribute_key, content, g AS grounded FROM h")
def current_attribute_heads(t):
    return versions.current_attribute_heads(memories(t), NEWEST).select("scope_owner", "entity_id", "attribute_key", "content", "grounded")


@query("current_attributes", ctes("summaries_v", more=_MEM) + """SELECT scope_owner, entity_id, string_agg(attribute_key || '=' || content, ',' ORDER BY attribute_key) AS attributes FROM h WHERE g GROUP BY ALL""")
def current_attributes(t):
    a = versions.current_attributes(memories(t), NEWEST)
    flat = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return a.select("scope_owner", "entity_id", F.array_join(flat, ",").alias("attributes"))


@query("term_frequency", f"""SELECT conv_id, turn, term, n FROM (SELECT conv_id, turn, term, count(*) AS n FROM (SELECT conv_id, turn, unnest({sql_tokens('text', X.THEME_STOP_WORDS)}) AS term FROM conversations) GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, term) <= 5""")
def term_frequency(t):
    return panels.term_frequency(t.conversations, ["conv_id", "turn"], top=5)


TOPICS_SQL = f"""tw AS (SELECT conv_id, turn, unnest({sql_tokens('text', X.THEME_STOP_WORDS)}) AS term FROM conversations),
 tc AS (SELECT conv_id, turn, term, count(*) AS n FROM tw GROUP BY conv_id, turn, term),
 tq AS (SELECT * FROM tc QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, term) <= 5),
 ts AS (SELECT term, sum(n)::BIGINT AS n FROM tc GROUP BY term),
 tg AS (SELECT * FROM (SELECT * FROM ts QUALIFY row_number() OVER (ORDER BY n DESC, term) <= 30) WHERE n >= 2)"""


def topics(t):
    c = t.conversations.select(F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner"), "conv_id", "turn", "text")
    return panels.term_frequency(c, [*SCOPE, "conv_id", "turn"], top=panels.TOPICS_PER_CONVERSATION)


def all_topics(t):
    c = t.conversations.select(F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner"), "conv_id", "turn", "text")
    return panels.term_counts(c, [*SCOPE, "conv_id", "turn"])


@query("global_topics", f"WITH {TOPICS_SQL} SELECT term, n FROM tg")
def global_topics(t):
    return panels.global_topics(all_topics(t)).select("term", "n")


@query("rollup_stale", ctes("current_v") + """, r AS (SELECT scope_owner, substr(period, 1, 4) AS period, min(created_at) + INTERVAL 400 DAY AS created_at FROM current_v GROUP BY ALL)
SELECT r.scope_owner, r.period, max(c.created_at) > any_value(r.created_at) AS stale FROM r JOIN current_v c ON r.scope_owner = c.scope_owner AND r.period = substr(c.period, 1, 4) GROUP BY ALL""")
def rollup_stale(t):
    from memspark.plans.consolidate import rollup_stale as stale

    cur = versions.current_versions(summaries(t))
    year = F.substring("period", 1, 4)
    r = cur.groupBy(*SCOPE, year.alias("period")).agg(
        (F.min("created_at") + F.expr("INTERVAL 400 DAYS")).alias("created_at"), F.collect_set("period").alias("source_summary_periods")
    )
    r = r.select(*SCOPE, F.lit("weekly").alias("level"), "period", "created_at", "source_summary_periods")
    return stale(r, cur.select(*SCOPE, "level", "period", "created_at")).select("scope_owner", "period", "stale")


@query("next_version", ctes("summaries_v") + "SELECT scope_owner, level, period, (max(version) + 1)::INTEGER AS next_version FROM summaries_v GROUP BY ALL")
def next_version(t):
    return versions.next_version(summaries(t)).drop("scope_kind")


@query("pending_embeddings", ctes("current_v", more=f"em AS (SELECT vec_id, label, {_MODELS} AS model FROM embeddings)") + """
SELECT 'vectors' AS tbl, count(*) AS n FROM em WHERE model IS DISTINCT FROM 'new:b'
UNION ALL SELECT 'facts', count(*) FROM current_v WHERE flag <> 'R'
UNION ALL SELECT 'episodes', count(*) FROM events WHERE event_type IN ('view', 'click', 'purchase') AND round(least(value / 100, 1.0), 4) >= 0.6""")
def pending_embeddings(t):
    from memspark.plans.maintain import pending_counts

    none = [F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("embedding_model")]
    s = summaries(t)
    pend = pending_counts(
        "new:b", tables={"vectors": with_models(t)}, episodes=episodes(t).select("*", *none), facts=facts(t).drop("supersedes").select("*", *none), summaries=s
    )
    return pend.select("tbl", "n")


@query("pending_backfill", """SELECT 'entities' AS tbl, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 25)
UNION ALL SELECT 'facts', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def pending_backfill(t):
    from memspark.plans.maintain import pending_backfill as pending

    scope = [F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner")]
    ent = t.part.select(*scope, F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.create_map(F.lit("brand"), "p_brand").alias("attributes"))
    fct = t.documents.select(*scope, F.col("doc_id").alias("id"))
    have_e = t.lineitem.filter("l_quantity >= 25").select(*scope, F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("entity_id"), F.lit("x").alias("id"), F.lit(True).alias("is_static"))
    have_f = t.labels.select(*scope, F.lit(None).cast("string").alias("entity_id"), F.concat(F.lit("mem_fact_"), F.col("doc_id").cast("string")).alias("id"), F.lit(False).alias("is_static"))
    return pending(ent, fct, have_e.unionByName(have_f))


@query("status_counters", ctes("audit_v") + """SELECT scope_owner, count(*) FILTER (event_type = 'capture') AS capture, count(*) FILTER (event_type = 'retrieve') AS retrieve,
 count(*) FILTER (event_type = 'export') AS export, count(*) FILTER (event_type = 'dashboard_login') AS dashboard_login, count(*) FILTER (event_type = 'correct') AS correct FROM audit_v GROUP BY 1""")
def status_counters(t):
    kinds = ["capture", "retrieve", "export", "dashboard_login", "correct"]
    return panels.status_counters(audit_log(t), "event_type", kinds).drop("scope_kind")


@query("truncated_flag", ctes("episodes_v") + "SELECT scope_owner, least(count(*), 50) AS n_shown, count(*) >= 50 AS truncated FROM episodes_v WHERE type = 'interaction' GROUP BY 1")
def truncated_flag(t):
    n = panels.interactions(episodes(t)).groupBy("scope_owner").agg(F.count(F.lit(1)).alias("n"))
    return n.select("scope_owner", panels.shown(F.col("n"), 50).alias("n_shown"), panels.truncated(F.col("n"), 50).alias("truncated"))
