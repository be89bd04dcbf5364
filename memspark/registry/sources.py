"""Sources, sinks and imports over whole tables; what is written is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.operators import scope as S
from memspark.operators import versions
from memspark.operators.scope import SCOPE
from memspark.registry import query
from memspark.registry.views import ctes, entities, episodes, facts, preference_edges, summaries
from memspark.session import materialize, scratch_path
from memspark.sources import bundle, chats, tables


@query("src_tables", ctes("episodes_v") + "SELECT id, ts, type, importance, scope_owner, ts::DATE AS day FROM episodes_v")
def src_tables(t):
    """Events stored as an episode table and loaded with the declared schema."""
    root = scratch_path(t.spark, "tables")
    tables.write_table(episodes(t), root, "episodes")
    e = tables.load_table(t.spark, root, "episodes")
    return e.select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "type", "importance", "scope_owner", "day")


def written(t):
    root = scratch_path(t.spark, "bundle")
    e = episodes(t).select("*", F.col("event_type").alias("input_text"), F.col("props").alias("output_text"))
    e = e.withColumn("hash", X.content_hash(F.col("input_text"), F.col("output_text")))
    fact = F.struct(
        F.col("part_id").alias("fact"), F.array("supplier_id").alias("source_episode_ids"), (F.col("flag") != "R").alias("grounded"), F.lit(0).alias("source_count"),
        F.lit(None).cast("string").alias("expires_at"), F.lit(None).cast("string").alias("expire_reason"), F.lit(False).alias("is_inference"),
    )
    s = summaries(t).withColumn("summary", F.col("part_id")).withColumn("key_facts", F.array(fact))
    n = t.part.select(F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("project").alias("kind"), F.col("p_name").alias("name"),
                      F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("attributes"))
    bundle.write_bundle(root, episodes=e, summaries=s, entities=n)
    return root


@query("src_bundle_episodes", ctes("episodes_v") + "SELECT id, ts, type, scope_owner, event_type AS input_text, 'sha256:' || sha256(event_type || chr(0) || props) AS hash FROM episodes_v")
def src_bundle_episodes(t):
    e = bundle.read_bundle(t.spark, written(t), "episodes")
    return e.select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "type", "scope_owner", "input_text", "hash")


@query("src_bundle_summaries", ctes("summaries_v") + "SELECT scope_owner, id AS summary_id, part_id AS fact, supplier_id AS source, flag <> 'R' AS grounded, 1 AS source_count FROM summaries_v")
def src_bundle_summaries(t):
    f = bundle.summary_facts(bundle.read_bundle(t.spark, written(t), "summaries"))
    return f.select("scope_owner", "summary_id", "fact", F.col("source_episode_ids")[0].alias("source"), "grounded", "source_count")


@query("src_bundle_entities", "SELECT 'part:' || p_partkey AS id, p_name AS name, p_brand AS brand, p_size::VARCHAR AS size FROM part")
def src_bundle_entities(t):
    e = bundle.read_bundle(t.spark, written(t), "entities")
    return e.select("id", "name", F.col("attributes")["brand"].alias("brand"), F.col("attributes")["size"].alias("size"))


@query("sink_bundle", ctes("episodes_v", "summaries_v") + """SELECT coalesce(e.scope_owner, s.scope_owner) AS scope_owner, coalesce(e.n, 0) AS episode_count, coalesce(s.n, 0) AS summary_count
 FROM (SELECT scope_owner, count(*) AS n FROM episodes_v GROUP BY 1) e FULL JOIN (SELECT scope_owner, count(*) AS n FROM summaries_v GROUP BY 1) s ON e.scope_owner = s.scope_owner UNION ALL SELECT 'team:all', 0, 0""")
def sink_bundle(t):
    m = t.spark.read.schema("scope_owner string, episode_count bigint, summary_count bigint").json(written(t) + "/manifest")
    return m.select("scope_owner", "episode_count", "summary_count")


@query("bundle_manifest", ctes("episodes_v") + "SELECT scope_owner, count(*) AS episode_count, min(ts) AS earliest_episode_at, max(ts) AS latest_episode_at FROM episodes_v GROUP BY 1")
def bundle_manifest(t):
    return bundle.bundle_manifest(episodes(t)).drop("scope_kind")


_IMP = """i AS (SELECT 'user:' || lang AS scope_owner, 'd' || doc_id AS id, doc_id, 'sha256:' || sha256(text || chr(0) || lang) AS hash, 'd' || (doc_id - 1) AS refers_to FROM documents),
 h AS (SELECT i.scope_owner, i.hash, i.id FROM i JOIN labels l ON l.doc_id = i.doc_id),
 f AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.scope_owner = i.scope_owner AND h.hash = i.hash) QUALIFY row_number() OVER (PARTITION BY scope_owner, hash ORDER BY doc_id) = 1)"""


def import_documents(t):
    d = t.documents.select(
        F.lit("private").alias("scope_kind"), F.concat(F.lit("user:"), "lang").alias("scope_owner"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "doc_id",
        X.content_hash(F.col("text"), F.col("lang")).alias("hash"), F.concat(F.lit("d"), (F.col("doc_id") - 1).cast("string")).alias("refers_to"),
        (F.lit("2024-01-01").cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("doc_id").cast("decimal(18,6)"))).alias("ts"),
    )
    have = d.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return have, d


@query("import_merge_episodes", f"WITH {_IMP} SELECT scope_owner, hash, doc_id FROM f")
def import_merge_episodes(t):
    """All documents come in, the labelled ones are there already; copies are skipped."""
    have, d = import_documents(t)
    rows, _ = bundle.import_merge_episodes(have, d)
    return rows.select("scope_owner", "hash", "doc_id")


@query("import_merge_stats", f"WITH {_IMP} SELECT i.scope_owner, count(DISTINCT f.id) AS imported, count(*) - count(DISTINCT f.id) AS skipped FROM i LEFT JOIN f ON f.id = i.id GROUP BY 1")
def import_merge_stats(t):
    _, stats = bundle.import_merge_episodes(*import_documents(t))
    return stats.drop("scope_kind")


_IMS = """inc AS (SELECT * FROM summaries_v), have AS (SELECT DISTINCT scope_owner, period FROM summaries_v WHERE flag = 'R' AND version = 1),
 fr AS (SELECT inc.* FROM inc WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.scope_owner = inc.scope_owner AND h.period = inc.period)),
 k AS (SELECT a.id, a.scope_owner, a.period, b.id AS up FROM fr a LEFT JOIN fr b ON a.supersedes = b.id AND a.scope_owner = b.scope_owner),
 r AS (SELECT id, scope_owner, period, 0 AS depth FROM k WHERE up IS NULL UNION ALL SELECT k.id, k.scope_owner, k.period, depth + 1 FROM k JOIN r ON k.up = r.id),
 nn AS (SELECT fr.id, fr.scope_owner, fr.supersedes, 'sum_' || fr.scope_owner || '_' || fr.period || '_daily_v' || row_number() OVER (PARTITION BY fr.scope_owner, fr.period ORDER BY depth, created_at, fr.id) AS nid FROM fr JOIN r ON r.id = fr.id)"""


@query("import_merge_summaries", ctes("summaries_v", recursive=True, more=_IMS) + "SELECT a.id AS exported_id, a.nid AS id, b.nid AS supersedes, a.supersedes IS NOT NULL AND b.nid IS NULL AS dangling FROM nn a LEFT JOIN nn b ON b.id = a.supersedes AND b.scope_owner = a.scope_owner")
def import_merge_summaries(t):
    s = summaries(t)
    rows, _ = bundle.import_merge_summaries(s.filter("flag = 'R' and version = 1"), s)
    return rows.select("exported_id", "id", "supersedes", "dangling")


@query("import_merge_entities", """SELECT 'part:' || p_partkey AS entity_id, unnest(['brand', 'size']) AS attribute_key, unnest([p_brand, p_size::VARCHAR]) AS content FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48 AND l_returnflag = 'R')""")
def import_merge_entities(t):
    """All parts come in, those sold in bulk are known; the new ones' attributes become memory rows."""
    scope = [F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner")]
    inc = t.part.select(*scope, F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("attributes"))
    have = t.lineitem.filter("l_quantity >= 48 and l_returnflag = 'R'").select(*scope, F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("id")).distinct()
    _, rows = bundle.import_merge_entities(have, inc)
    return rows.select("entity_id", "attribute_key", "content")


@query("import_merge_relations", ctes("facts_v") + """, p AS (SELECT a.scope_owner, a.id AS f, b.id AS t FROM facts_v a JOIN facts_v b ON a.supersedes = b.summary_id AND a.scope_owner = b.scope_owner)
SELECT 'mem_fact_' || f AS from_memory_id, 'mem_fact_' || t AS to_memory_id, 'updates' AS relation_type FROM p WHERE f % 3 <> 0 AND t % 4 <> 1""")
def import_merge_relations(t):
    """Version links as locators: every third from-text is unknown, some links are there already."""
    f = materialize(facts(t).select(*SCOPE, "id", "summary_id", "fact", "supersedes"), "facts")
    loc = "struct<summary_id:string,fact:string,entity_id:string,attribute_key:string>"
    text = F.when(F.col("id") % 3 == 0, F.concat("fact", F.lit("?"))).otherwise(F.col("fact"))

    def locator(summary, fact):
        return F.struct(F.concat(F.lit("old_"), summary), fact, F.lit(None).cast("string"), F.lit(None).cast("string")).cast(loc)

    old = f.select(*SCOPE, F.col("summary_id").alias("supersedes"), locator(F.col("summary_id"), F.col("fact")).alias("to"), F.col("id").alias("to_id"))
    inc = f.filter("supersedes is not null").select(*SCOPE, "supersedes", F.col("id").alias("from_id"), locator(F.col("summary_id"), text).alias("from")).join(old, [*SCOPE, "supersedes"])
    have = inc.filter("to_id % 4 = 1").select(*SCOPE, X.fact_memory_id(F.col("from_id")).alias("from_memory_id"), X.fact_memory_id(F.col("to_id")).alias("to_memory_id"), F.lit("updates").alias("relation_type"))
    ids = f.select(*SCOPE, F.concat(F.lit("old_"), "summary_id").alias("exported_id"), "summary_id")
    heads = f.select(*SCOPE, F.lit("e").alias("entity_id"), F.lit("k").alias("attribute_key"), F.lit("m").alias("id")).filter("1 = 0")
    out = bundle.import_merge_relations(have, inc.withColumn("relation_type", F.lit("updates")), summary_ids=ids, facts=f, heads=heads)
    return out.select("from_memory_id", "to_memory_id", "relation_type")


@query("import_empty_check", ctes("episodes_v", "summaries_v") + """, a AS (SELECT scope_owner FROM episodes_v UNION ALL SELECT scope_owner FROM summaries_v)
SELECT 'user:' || c_custkey AS scope_owner, count(a.scope_owner) AS n_rows, count(a.scope_owner) = 0 AS is_empty FROM customer LEFT JOIN a ON a.scope_owner = 'user:' || c_custkey GROUP BY 1""")
def import_empty_check(t):
    targets = t.customer.select(F.lit("private").alias("scope_kind"), F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("scope_owner"))
    return S.import_empty_check(targets, episodes(t), summaries(t)).drop("scope_kind")


@query("delete_scopes", ctes("episodes_v") + "SELECT id FROM episodes_v e WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_scopes(t):
    doomed = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.lit("private").alias("scope_kind"), F.concat(F.lit("user:"), F.col("c_custkey").cast("string")).alias("scope_owner"))
    return S.delete_scopes(episodes(t), doomed).select("id")


def spoken(c):
    return F.concat(F.lower(F.date_format(c, "h:mm a")), F.date_format(c, " 'on' d MMMM, yyyy"))


def day_of_conversation():
    return F.lit("2024-01-01").cast("date") + F.make_dt_interval((F.col("conv_id") % 28).cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(18,6)"))


_BLOCK = "SELECT conv_id || '-' || (turn // 6) AS sample_id, conv_id, turn, role, text FROM conversations"


@query("src_locomo", f"SELECT sample_id, 1 + (turn % 6) // 3 AS session_no, TIMESTAMP '2024-01-01 09:30:00' + to_days((conv_id % 28)::INTEGER) AS session_at, (turn % 3)::INTEGER AS pos, role AS speaker, text FROM ({_BLOCK})")
def src_locomo(t):
    """Six turns of a conversation as a sample of two sessions, written as JSON and read back."""
    at = day_of_conversation().cast("timestamp_ntz") + F.expr("INTERVAL '09:30' HOUR TO MINUTE")
    turn = F.struct(F.col("turn").alias("o"), F.struct(F.col("role").alias("speaker"), "text").alias("v"))
    base = t.conversations.groupBy(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.floor(F.col("turn") / 6).cast("string")).alias("sample_id")).agg(
        spoken(F.min(at)).alias("at"),
        *[F.transform(F.array_sort(F.collect_list(F.when((F.floor(F.col("turn") / 3) % 2) == n, turn))), lambda r: r["v"]).alias(f"s{n}") for n in (0, 1)],
    )
    one = F.struct(F.col("s0").alias("session_1"), F.col("at").alias("session_1_date_time"))
    two = F.struct(F.col("s0").alias("session_1"), F.col("at").alias("session_1_date_time"), F.col("s1").alias("session_2"), F.col("at").alias("session_2_date_time"))
    conv = F.when(F.size("s1") > 0, F.to_json(two)).otherwise(F.to_json(one))
    line = F.concat(F.lit('{"sample_id":"'), "sample_id", F.lit('","conversation":'), conv, F.lit(',"qa":[{"question":"q","answer":7,"category":1}]}'))
    path = scratch_path(t.spark, "samples")
    base.select(line.alias("value")).write.text(path)
    turns = chats.sample_turns(chats.read_samples(t.spark, path, many_lines=False))
    return turns.withColumn("session_at", F.col("session_at").cast("timestamp_ntz"))


@query("src_longmemeval", f"SELECT sample_id AS question_id, ((turn % 6) // 3)::INTEGER AS session_no, TIMESTAMP '2024-01-01 09:30:00' + to_days((conv_id % 28)::INTEGER) AS session_at, (turn % 3)::INTEGER AS pos, role, text AS content FROM ({_BLOCK})")
def src_longmemeval(t):
    at = day_of_conversation().cast("timestamp_ntz") + F.expr("INTERVAL '09:30' HOUR TO MINUTE")
    sid = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.floor(F.col("turn") / 6).cast("string"))
    turn = F.struct(F.col("turn").alias("o"), F.struct("role", F.col("text").alias("content")).alias("v"))
    s = t.conversations.groupBy(sid.alias("question_id"), (F.floor(F.col("turn") / 3) % 2).alias("n")).agg(F.min(at).alias("at"), F.array_sort(F.collect_list(turn)).alias("turns"))
    s = s.withColumn("turns", F.transform("turns", lambda r: r["v"]))
    rows = F.array_sort(F.collect_list(F.struct("n", F.date_format("at", "yyyy/MM/dd (EEE) HH:mm").alias("d"), F.col("turns").alias("t"))))
    q = s.groupBy("question_id").agg(rows.alias("r"))
    doc = F.struct("question_id", F.transform("r", lambda x: x["d"]).alias("haystack_dates"), F.transform("r", lambda x: x["t"]).alias("haystack_sessions"))
    path = scratch_path(t.spark, "haystacks")
    q.select(F.to_json(doc).alias("value")).write.text(path)
    turns, _ = chats.haystack_turns(chats.read_haystacks(t.spark, path, many_lines=False))
    return turns.withColumn("session_at", F.col("session_at").cast("timestamp_ntz"))


@query("sessionize_turns", """SELECT conv_id AS session_index, turn // 4 AS part_no, count(*) AS n_turns, TIMESTAMP '2024-01-01 15:04:00' + to_days((conv_id % 28)::INTEGER) AS session_at,
 md5(regexp_replace(string_agg(role || ': ' || text, chr(10) ORDER BY turn), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS digest FROM conversations WHERE conv_id % 10 <> 9 GROUP BY ALL""")
def sessionize_turns(t):
    """Conversations as sessions: the date stands on the first turn, a tenth has none and is refused."""
    at = day_of_conversation().cast("timestamp_ntz") + F.expr("INTERVAL '15:04' HOUR TO MINUTE")
    date = F.when((F.col("turn") == 0) & (F.col("conv_id") % 10 != 9), spoken(at)).otherwise("")
    flat = t.conversations.select(F.col("conv_id").alias("session_index"), date.alias("session_datetime"), F.col("role").alias("speaker"), "text", F.col("turn").alias("ord"))
    good, _ = chats.sessionize_turns(flat, per_part=4)
    return good.select("session_index", "part_no", "n_turns", F.col("session_at").cast("timestamp_ntz").alias("session_at"), F.md5("text").alias("digest"))


@query("turn_text", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN html WHEN 1 THEN '[Shared image: ' || CASE WHEN url LIKE '%/' THEN url ELSE regexp_extract(url, '[^/]*$') END || ']' || chr(10) || 'a page' ELSE html || chr(10) || '[Shared image: ' || CASE WHEN url LIKE '%/' THEN url ELSE regexp_extract(url, '[^/]*$') END || ']' || chr(10) || 'a page' END AS text FROM pages""")
def turn_text(t):
    m = F.col("page_id") % 3
    own = F.when(m == 1, F.lit(" ")).otherwise(F.col("html"))
    return t.pages.select("page_id", X.turn_text(own, F.col("url"), F.when(m != 0, F.lit("a page"))).alias("text"))


def answers(t):
    """User turns as questions, the turn after as the prediction; every seventh is missing."""
    from memspark.registry.scalars import exchanges

    x = exchanges(t)
    return x.select("conv_id", F.col("turn").alias("question_no"), F.col("input_text").alias("question"), F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.lit("")).otherwise(F.col("output_text")).alias("prediction"))


_ANS = "WITH x AS (SELECT a.conv_id, a.turn AS question_no, a.text AS question, CASE WHEN (a.conv_id + a.turn) % 7 = 0 THEN '' ELSE b.text END AS prediction FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE a.role = 'user' AND b.role = 'assistant') "


@query("sink_predictions", _ANS + "SELECT conv_id, question_no, question, prediction FROM x")
def sink_predictions(t):
    """Nested predictions written as JSON lines and read back."""
    path = scratch_path(t.spark, "predictions")
    chats.predictions(answers(t), "conv_id", per_part=2).select(F.col("json").alias("value")).write.text(path)
    back = t.spark.read.schema("conv_id bigint, qa array<struct<question_no:bigint,question:string,prediction:string>>").json(path)
    return back.select("conv_id", F.inline("qa"))


@query("resume_pending", _ANS + "SELECT DISTINCT conv_id FROM x WHERE prediction = ''")
def resume_pending(t):
    a = answers(t)
    return chats.pending_samples(a.select("conv_id", "question_no"), a.withColumnRenamed("prediction", "answer"), "conv_id")


_EXP = """SELECT 'team:all' AS scope_owner, 1 AS section, 'part:' || p_partkey AS sort_key, '{"id":"part:' || p_partkey || '","kind":"project","name":"' || p_name || '"}' AS line FROM part
UNION ALL SELECT c.scope_owner, 2, c.period || '|' || c.id, '{"id":"' || c.id || '","period":"' || c.period || '","level":"daily","key_facts":[{"fact":"' || f.fact || '","grounded":' || f.grounded || ',"source_count":' || f.source_count || '}]}' FROM current_v c JOIN facts_v f ON f.summary_id = c.id
UNION ALL SELECT scope_owner, 3, 'rel_' || order_no, '{"id":"rel_' || order_no || '","subject_id":"' || subject_id || '","predicate":"prefers","object_id":"' || object_id || '","valid_from":"' || valid_from || '"}' FROM prefs_v"""


@query("sink_memory_export", ctes("current_v", "facts_v", "prefs_v") + _EXP)
def sink_memory_export(t):
    n = t.part.select(F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner"), F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), F.lit("project").alias("kind"), F.col("p_name").alias("name"))
    r = preference_edges(t).select(*SCOPE, F.concat(F.lit("rel_"), F.col("order_no").cast("string")).alias("id"), "subject_id", "predicate", "object_id", "valid_from", F.lit(None).cast("date").alias("valid_until"))
    path = scratch_path(t.spark, "export")
    bundle.write_memory_export(bundle.memory_export(n, versions.current_versions(summaries(t)), facts(t), r), path)
    return t.spark.read.schema("scope_owner string, section int, sort_key string, line string").json(path)
