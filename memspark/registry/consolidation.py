"""Consolidation jobs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.functions import timeex as D
from memspark.functions.vectors import hash_embed
from memspark.operators import versions
from memspark.operators.scope import SCOPE
from memspark.plans import consolidate
from memspark.registry import query
from memspark.session import materialize
from memspark.operators.graph import CLUSTER_MIN_SOURCES
from memspark.registry.aggregates import _MEM, memories, NEWEST
from memspark.registry.views import ctes, episodes, facts, preference_edges, sentences, summaries, vectors


def event_chats(t):
    """Events as exchanges."""
    return episodes(t).withColumn("input_text", F.col("event_type")).withColumn("output_text", F.col("props"))


@query("daily_sources", ctes("episodes_v") + """, p AS (SELECT *, ts::DATE AS day, row_number() OVER (PARTITION BY scope_owner, ts::DATE ORDER BY ts, id) AS pos FROM episodes_v WHERE type = 'interaction')
SELECT scope_owner, day, (pos - 1) // 3 AS part_no, count(*) AS n_sources, md5(string_agg('--- id: ' || id || ' (date: ' || day || ') ---' || chr(10) || 'USER: ' || event_type || chr(10) || 'ASSISTANT: ' || props || chr(10) || chr(10), '' ORDER BY pos)) AS block
FROM p GROUP BY ALL""")
def daily_sources(t):
    d = consolidate.daily_sources(event_chats(t), per_part=3)
    return d.select("scope_owner", "day", "part_no", "n_sources", F.md5("text").alias("block"))


def stand_in():
    """A task function that stands in for a model: every source's first line becomes a fact."""

    def extractor(batches):
        import pandas as pd

        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                lines = [x for x in r["text"].split("\n") if x.startswith("USER: ")]
                facts = [{"fact": x[6:], "source_episode_ids": [i]} for x, i in zip(lines, r["source_ids"])]
                rows.append((r["scope_kind"], r["scope_owner"], r["day"], r["cluster"], r["part_no"], f"{len(lines)} sources", facts, [], [], None))
            yield pd.DataFrame(rows, columns=["scope_kind", "scope_owner", "day", "cluster", "part_no", "summary", "key_facts", "entities", "relationships", "error"])

    return extractor


@query("daily_digest", ctes("episodes_v") + "SELECT scope_owner, ts::DATE AS day, count(*) AS n_facts FROM episodes_v WHERE type = 'interaction' GROUP BY ALL")
def daily_digest(t):
    """Every day of every scope through clustering and a stand-in extractor; no source is lost."""
    out = consolidate.daily_digest(event_chats(t), hash_embed(16), stand_in(), dimensions=16, min_sources=CLUSTER_MIN_SOURCES)
    return out.groupBy("scope_owner", "day").agg(F.sum(F.size("key_facts")).alias("n_facts"))


@query("merge_outputs", """SELECT conv_id, turn // 6 AS block, coalesce(string_agg(CASE WHEN trim(text) <> '' THEN text END, chr(10) || chr(10) ORDER BY turn), '') AS summary, string_agg(role, ',' ORDER BY turn) AS facts FROM conversations GROUP BY ALL""")
def merge_outputs(t):
    """Turns as cluster outputs, six to a digest."""
    o = t.conversations.select("conv_id", F.floor(F.col("turn") / 6).alias("block"), "turn", F.col("text").alias("summary"), F.array("role").alias("key_facts"))
    m = consolidate.merge_outputs(o, ["conv_id", "block"], "turn")
    return m.select("conv_id", "block", "summary", F.array_join("key_facts", ",").alias("facts"))


_DUE = """dd AS (SELECT DISTINCT o_orderdate::DATE AS date FROM orders),
 wk AS (SELECT date, 'weekly' AS level, 'daily' AS source_level, lpad(isoyear(date - 1)::VARCHAR, 4, '0') || '-W' || lpad(week(date - 1)::VARCHAR, 2, '0') AS period,
  (SELECT string_agg(strftime(date - i::INTEGER, '%Y-%m-%d'), ',' ORDER BY i DESC) FROM range(1, 8) r(i)) AS sources FROM dd WHERE isodow(date) = 1),
 mo AS (SELECT date, 'monthly', 'weekly', strftime(date - 1, '%Y-%m'), (SELECT string_agg(lpad(isoyear(x)::VARCHAR, 4, '0') || '-W' || lpad(week(x)::VARCHAR, 2, '0'), ',' ORDER BY x) FROM
  (SELECT date - i::INTEGER AS x FROM range(1, 32) r(i)) WHERE isodow(x) = 1 AND strftime(x, '%Y-%m') = strftime(date - 1, '%Y-%m')) FROM dd WHERE day(date) = 1),
 yr AS (SELECT date, 'yearly', 'monthly', strftime(date - 1, '%Y'), (SELECT string_agg(strftime(date - 1, '%Y') || '-' || lpad(i::VARCHAR, 2, '0'), ',' ORDER BY i) FROM range(1, 13) r(i)) FROM dd WHERE dayofyear(date) = 1),
 due AS (SELECT * FROM wk UNION ALL SELECT * FROM mo UNION ALL SELECT * FROM yr)"""


def order_dates(t):
    return t.orders.select(F.to_date("o_orderdate").alias("date")).distinct()


@query("due_rollups", f"WITH {_DUE} SELECT * FROM due")
def due_rollups(t):
    r = consolidate.due_rollups(order_dates(t))
    return r.select("date", "level", "source_level", "period", F.array_join("source_periods", ",").alias("sources"))


_ROLL = f"""{_DUE}, src AS (SELECT scope_owner, id, period AS p FROM current_v), w AS (SELECT DISTINCT level, period, unnest(string_split(sources, ',')) AS p FROM wk)"""


@query("run_rollup", ctes("current_v", more=_ROLL) + """SELECT scope_owner, level, w.period, 'sum_' || scope_owner || '_' || w.period || '_weekly_v1' AS id, count(*)::INTEGER AS n_sources, md5(string_agg(src.id, ',' ORDER BY src.p, src.id)) AS digest FROM w JOIN src ON src.p = w.p GROUP BY ALL""")
def run_rollup(t):
    """Weekly digests of all scopes from the current daily ones; weeks come from the calendar."""
    s = summaries(t).select(*SCOPE, "id", "level", "period", "created_at", "supersedes", F.col("part_id").alias("summary"))
    r = consolidate.run_rollup(s, consolidate.due_rollups(order_dates(t)))
    return r.select("scope_owner", "level", "period", "id", "n_sources", F.md5(F.array_join("source_ids", ",")).alias("digest"))


@query("refresh_cascade", ctes("current_v") + """, c AS (SELECT DISTINCT scope_owner, period::DATE AS d FROM current_v WHERE correction_reason IS NOT NULL),
 w AS (SELECT DISTINCT scope_owner, date_trunc('week', d)::DATE AS m FROM c)
SELECT scope_owner, 'weekly' AS level, lpad(isoyear(m)::VARCHAR, 4, '0') || '-W' || lpad(week(m)::VARCHAR, 2, '0') AS period FROM w UNION SELECT scope_owner, 'monthly', strftime(m, '%Y-%m') FROM w UNION SELECT scope_owner, 'yearly', strftime(m, '%Y') FROM w""")
def refresh_cascade(t):
    """Corrected days upward; the rollups of every scope are those its days belong to."""
    cur = versions.current_versions(summaries(t))
    day = F.to_date("period")
    week = D.monday(day)
    days = cur.select(*SCOPE, "period", week.alias("m")).distinct()

    def rollup(level, period, source):
        return days.groupBy(*SCOPE, F.lit(level).alias("level"), period.alias("period")).agg(F.collect_set(source).alias("source_summary_periods"))

    m = F.col("m")
    rollups = (
        rollup("weekly", D.period_key(m, "weekly"), F.col("period")).unionByName(rollup("monthly", D.period_key(m, "monthly"), D.period_key(m, "weekly")))
        .unionByName(rollup("yearly", D.period_key(m, "yearly"), D.period_key(m, "monthly")))
    )
    changed = cur.filter("correction_reason is not null").select(*SCOPE, "level", "period")
    return consolidate.refresh_cascade(changed, rollups).drop("scope_kind")


@query("citation_validate", ctes("summaries_v") + "SELECT id, CASE WHEN version % 3 = 0 THEN '' ELSE CASE WHEN part % 2 = 0 THEN part_id || ',' || part_id || ',' ELSE '' END || supplier_id END AS cites FROM summaries_v")
def citation_validate(t):
    s = summaries(t)
    level = F.when(F.col("version") % 3 == 0, "weekly").otherwise("daily")
    src = F.when(F.col("part") % 2 == 0, F.array("part_id", "supplier_id")).otherwise(F.array("supplier_id"))
    f = s.select("id", level.alias("level"), F.array("part_id", "part_id", F.lit("made-up"), "supplier_id").alias("cites"), src.alias("source_episode_ids"))
    return consolidate.citation_validate(f).select("id", F.array_join("cites", ",").alias("cites"))


@query("grounding_resolve", ctes("sentences_v") + "SELECT summary_id, pos + 1 AS fact_no, CASE WHEN pos % 11 = 10 THEN TRUE ELSE (pos - pos // 11) % 5 <> 4 AND pos % 3 <> 0 END AS grounded FROM sentences_v")
def grounding_resolve(t):
    """Lines of documents with a judge that skips every fifth, answers some twice and chats around it."""
    s = sentences(t).select("summary_id", (F.col("pos") + 1).alias("fact_no"), "pos", (F.col("pos") % 11 == 10).alias("is_inference"))
    lit = s.filter(~F.col("is_inference")).withColumn("n", F.col("pos") - F.floor(F.col("pos") / 11)).filter("n % 5 <> 4")
    i = (F.col("n") % 20 + 1).cast("int").alias("i")
    ok = F.col("pos") % 3 != 0
    answer = lit.groupBy("summary_id", F.floor(F.col("n") / 20).alias("batch_no")).agg(
        F.array_sort(F.collect_list(F.struct("n", F.struct(i, ok.alias("ok")).alias("v")))).alias("a"), F.array_sort(F.collect_list(F.struct("n", F.struct(i, (~ok).alias("ok")).alias("v")))).alias("b")
    )
    both = F.concat(F.transform("a", lambda r: r["v"]), F.transform("b", lambda r: r["v"]))
    text = F.concat(F.lit("Verdict: "), F.to_json(F.struct(both.alias("grounded"))), F.lit(" done."))
    v = answer.select("summary_id", "batch_no", text.alias("answer"))
    return consolidate.grounding_resolve(s.drop("pos"), v, ["summary_id"]).select("summary_id", "fact_no", "grounded")


def stand_in_judge(prompts):
    """Stands in for a model: facts of a byte length that three does not divide are true; it refuses licences."""
    import json

    out = []
    for p in prompts:
        listed = p.split("\n")[1]
        if "licen" in listed.lower():
            raise ValueError("refused")
        said = [{"i": f["i"], "ok": len(f["fact"].encode()) % 3 != 0} for f in json.loads(listed.removeprefix("FACTS "))]
        out.append("My verdict: " + json.dumps({"grounded": said}))
    return out


_JUDGED = """lit AS (SELECT *, (row_number() OVER (PARTITION BY summary_id ORDER BY pos) - 1) // 20 AS b FROM sentences_v WHERE pos % 11 <> 10),
 bad AS (SELECT summary_id, b FROM lit GROUP BY ALL HAVING bool_or(contains(lower(fact), 'licen')))"""


@query("judged_grounding", ctes("sentences_v", more=_JUDGED) + """SELECT lit.summary_id, pos + 1 AS fact_no, bad.b IS NULL AND strlen(fact) % 3 <> 0 AS grounded, CASE WHEN bad.b IS NOT NULL THEN 'ValueError: refused' END AS error
 FROM lit LEFT JOIN bad ON bad.summary_id = lit.summary_id AND bad.b = lit.b UNION ALL SELECT summary_id, pos + 1, TRUE, NULL FROM sentences_v WHERE pos % 11 = 10""")
def judged_grounding(t):
    """Lines of documents before a judge that refuses some prompts; the others of its call are answered all the same."""
    from memspark.plans import judge

    s = sentences(t).select("summary_id", (F.col("pos") + 1).alias("fact_no"), "fact", (F.col("pos") % 11 == 10).alias("is_inference"))
    src = s.select("summary_id").distinct().withColumn("source", F.concat(F.lit("digest "), "summary_id"))
    return judge.judged_grounding(s, ["summary_id"], src, stand_in_judge).select("summary_id", "fact_no", "grounded", "error")


@query("attribution_resolve", "SELECT o_orderkey, unnest([0, 1, 2])::INTEGER AS pos, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [NULL, NULL, NULL] ELSE [TRUE, o_orderkey % 2 = 0, FALSE] END) AS used FROM orders")
def attribution_resolve(t):
    flags = F.array(F.lit(True), F.col("o_orderkey") % 2 == 0, F.lit(False))
    said = F.when(F.col("o_orderkey") % 3 == 0, F.slice(flags, 1, 2)).otherwise(flags)
    a = t.orders.select("o_orderkey", F.array("o_orderstatus", "o_orderpriority", F.lit("x")).alias("citations"), F.concat(F.lit("so: "), F.to_json(F.struct(said.alias("used")))).alias("answer"))
    return consolidate.attribution_resolve(a, ["o_orderkey"]).select("o_orderkey", "pos", "used")


_STORE = """SELECT 'sum_' || scope_owner || '_' || period || '_daily_v' || (max(version) + 1) AS id, scope_owner, period, count(*) AS n_facts, count(*) FILTER (flag <> 'R') AS n_grounded FROM summaries_v GROUP BY scope_owner, period"""


@query("store_summary", ctes("summaries_v") + _STORE)
def store_summary(t):
    """A new version of every (scope, day) with one fact per earlier version."""
    s = summaries(t)
    none = F.lit(None).cast("string")
    fact = F.struct(
        F.col("part_id").alias("fact"), F.array("part_id").alias("cites"), (F.col("flag") != "R").alias("grounded"), F.lit("2001-02-30").alias("expires_at"), F.lit("soon").alias("expire_reason"),
        F.lit(0).alias("source_count"), F.lit(False).alias("is_inference"),
    )
    out = s.groupBy(*SCOPE, "level", "period").agg(F.collect_list(fact).alias("key_facts"), F.max("part_id").alias("summary"))
    empty = F.array().cast("array<string>")
    out = out.select("*", empty.alias("source_episode_ids"), empty.alias("entities_touched"), none.alias("supersedes"), none.alias("correction_reason"))
    rows = consolidate.store_summary(out, s, created_at=F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    n = rows["memories"].groupBy(*SCOPE, F.col("summary_id").alias("id")).agg(F.count(F.lit(1)).alias("n_facts"), F.count(F.when(F.col("grounded") & F.col("expires_at").isNull(), 1)).alias("n_grounded"))
    return rows["summaries"].join(n, [*SCOPE, "id"]).select("id", "scope_owner", "period", "n_facts", "n_grounded")


@query("correct_summary", ctes("summaries_v", more="""nx AS (SELECT supersedes AS id, scope_owner, max(id) AS nid FROM summaries_v WHERE supersedes IS NOT NULL GROUP BY ALL),
 mv AS (SELECT scope_owner, period, max(version) AS v FROM summaries_v GROUP BY ALL)""") + """SELECT s.id AS summary_id, CASE WHEN correction_reason IS NULL THEN 'reason required' WHEN nid IS NOT NULL THEN 'already superseded by ' || nid END AS problem,
 CASE WHEN correction_reason IS NOT NULL AND nid IS NULL THEN 'sum_' || s.scope_owner || '_' || s.period || '_daily_v' || (v + 1) END AS new_id
 FROM summaries_v s LEFT JOIN nx ON nx.id = s.id AND nx.scope_owner = s.scope_owner JOIN mv ON mv.scope_owner = s.scope_owner AND mv.period = s.period""")
def correct_summary(t):
    """A correction for every version; those without a reason or already superseded are refused."""
    s = summaries(t)
    c = s.select(*SCOPE, F.col("id").alias("summary_id"), F.lit("corrected").alias("summary"), F.col("correction_reason").alias("reason"))
    good, bad = consolidate.correct_summary(c, s)
    a = good.select(F.col("supersedes").alias("summary_id"), F.lit(None).cast("string").alias("problem"), F.col("id").alias("new_id"))
    return a.unionByName(bad.select("summary_id", "problem", F.lit(None).cast("string").alias("new_id")))


@query("entity_upsert", """WITH u AS (SELECT c_custkey, max(o_orderdate)::DATE AS last, min(o_orderdate)::DATE AS first FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT 'person:' || regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS id, CASE WHEN u.c_custkey IS NOT NULL THEN c_name ELSE upper(c_name) END AS name,
 CASE WHEN c_mktsegment = 'BUILDING' THEN DATE '1990-01-01' ELSE u.first END AS first_seen, coalesce(u.last, DATE '1990-01-01') AS last_updated FROM customer c LEFT JOIN u ON u.c_custkey = c.c_custkey WHERE c_mktsegment = 'BUILDING' OR u.c_custkey IS NOT NULL""")
def entity_upsert(t):
    """Customers of one segment are known; every order touches its customer, robots are no kind."""
    scope = [F.lit("private").alias("scope_kind"), F.lit("user:all").alias("scope_owner")]
    name = F.col("c_name")
    old = F.lit("1990-01-01").cast("date")
    have = t.customer.filter("c_mktsegment = 'BUILDING'").select(*scope, X.entity_id(F.lit("person"), name, F.lit("")).alias("id"), F.lit("person").alias("kind"), F.upper(name).alias("name"), old.alias("first_seen"), old.alias("last_updated"))
    touch = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(*scope, F.lit("person").alias("kind"), name.alias("name"), F.lit("").alias("id"), F.to_date("o_orderdate").alias("as_of"))
    robots = t.supplier.select(*scope, F.lit("robot").alias("kind"), F.col("s_name").alias("name"), F.lit("").alias("id"), old.alias("as_of"))
    return versions.entity_upsert(have, touch.unionByName(robots)).select("id", "name", "first_seen", "last_updated")


_SCD = """, u AS (SELECT DISTINCT scope_owner, entity_id FROM m)
SELECT u.scope_owner, u.entity_id, 'quantity0' AS attribute_key, 'new' AS content, TRUE AS grounded, h.id AS supersedes FROM u LEFT JOIN h ON h.scope_owner = u.scope_owner AND h.entity_id = u.entity_id AND h.attribute_key = 'quantity0'
UNION ALL SELECT scope_owner, entity_id, attribute_key, '', FALSE, id FROM h WHERE """


def scd_input(t):
    u = memories(t).select(*SCOPE, "entity_id").distinct()
    u = u.select("*", F.create_map(F.lit("quantity0"), F.lit("new")).alias("attributes"), F.array(F.lit("supplier0"), F.lit("missing")).alias("supersedes_keys"))
    return memories(t), u


@query("attribute_scd2", ctes("summaries_v", more=_MEM) + _SCD + "attribute_key = 'supplier0'")
def attribute_scd2(t):
    return versions.attribute_scd2(*scd_input(t), newest=NEWEST).select("scope_owner", "entity_id", "attribute_key", "content", "grounded", "supersedes")


@query("attribute_scd2_replace", ctes("summaries_v", more=_MEM) + _SCD + "attribute_key <> 'quantity0'")
def attribute_scd2_replace(t):
    return versions.attribute_scd2(*scd_input(t), replace=True, newest=NEWEST).select("scope_owner", "entity_id", "attribute_key", "content", "grounded", "supersedes")


_CLOSED = """SELECT subject_id, object_id, valid_from, (SELECT min(n.valid_from) FROM prefs_v n WHERE n.subject_id = p.subject_id AND n.object_id <> p.object_id AND n.valid_from > p.valid_from) AS valid_until FROM prefs_v p"""


def edge_input(t):
    e = preference_edges(t).drop("order_no").withColumn("valid_until", F.lit(None).cast("date"))
    ids = e.select(*SCOPE, F.col("subject_id").alias("id")).union(e.select(*SCOPE, "object_id")).distinct()
    return e, ids


@query("relationship_upsert", ctes("prefs_v") + _CLOSED)
def relationship_upsert(t):
    """A customer's changing preference: every dated edge ends the open ones that point elsewhere."""
    e, ids = edge_input(t)
    out = versions.relationship_upsert(e.filter("1 = 0").drop("arrival"), e, ids)
    return out.select("subject_id", "object_id", "valid_from", "valid_until")


_RAW = """raw AS (SELECT o_orderkey AS arrival, CASE o_orderkey % 5 WHEN 4 THEN 'robot' ELSE 'person' END AS kind, CASE WHEN o_orderkey % 7 = 3 THEN '--' ELSE o_custkey::VARCHAR END AS name,
 CASE WHEN o_orderkey % 11 = 5 THEN repeat('x', 70) WHEN o_orderkey % 13 = 6 THEN ' ' ELSE 'prefers' END AS predicate, substr(o_orderpriority, 1, 1) AS object FROM orders)"""


@query("relationship_rejects", f"WITH {_RAW}" + """ SELECT arrival, CASE WHEN kind = 'robot' THEN 'unknown kind' WHEN length(predicate) > 64 THEN 'predicate too long' WHEN predicate = ' ' THEN 'no predicate' WHEN name = '--' THEN 'no identifier' ELSE 'unknown entity' END AS reason
 FROM raw WHERE kind = 'robot' OR predicate <> 'prefers' OR name = '--' OR object IN ('4', '5')""")
def relationship_rejects(t):
    """What a batch of raw updates loses, and why; objects 4 and 5 are unknown."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    raw = t.orders.select(
        F.lit("private").alias("scope_kind"), F.lit("user:all").alias("scope_owner"), k.alias("arrival"), F.when(k % 5 == 4, "robot").otherwise("person").alias("subject_kind"),
        F.when(k % 7 == 3, "--").otherwise(F.col("o_custkey").cast("string")).alias("subject_name"),
        F.when(k % 11 == 5, "x" * 70).when(k % 13 == 6, " ").otherwise("prefers").alias("predicate"), F.lit("preference").alias("object_kind"),
        F.substring("o_orderpriority", 1, 1).alias("object_name"), none.alias("valid_from"), none.alias("valid_until"),
    )
    known = raw.select(*SCOPE, X.entity_id(F.lit("person"), F.col("subject_name"), F.lit("")).alias("id")).union(
        raw.filter("object_name not in ('4', '5')").select(*SCOPE, X.entity_id(F.lit("preference"), F.col("object_name"), F.lit(""))))
    return versions.rejected_edges(raw, known.distinct()).select("arrival", "reason")


@query("relationship_upsert_ordered", ctes("prefs_v") + _CLOSED)
def relationship_upsert_ordered(t):
    e, _ = edge_input(t)
    return versions.relationship_upsert_ordered(e, F.year("valid_from")).select("subject_id", "object_id", "valid_from", "valid_until")


_VERD = """v AS (SELECT id, fact, summary_id, source_count, CASE id % 4 WHEN 0 THEN 'kept' WHEN 1 THEN 'removed' WHEN 2 THEN 'replaced' ELSE 'reinforced' END AS outcome FROM facts_v)"""


@query("contradiction_apply", ctes("facts_v", more=_VERD) + "SELECT id, CASE WHEN outcome = 'replaced' THEN fact || ' now' ELSE fact END AS fact, CASE WHEN outcome = 'reinforced' THEN greatest(source_count, 1) + 2 ELSE source_count END AS source_count, outcome FROM v")
def contradiction_apply(t):
    f = facts(t)
    m = F.col("id") % 4
    reason = F.when(m == 3, "redundant").otherwise("changed")
    text = F.when(m == 2, F.concat("fact", F.lit(" now"))).otherwise("")
    v = f.filter(m != 0).select(*SCOPE, "summary_id", F.col("fact").alias("old_fact"), text.alias("replacement"), reason.alias("reason"), F.explode(F.when(m == 3, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("ord"))
    return consolidate.contradiction_apply(f, v).select("id", "fact", "source_count", "outcome")


@query("relation_record", ctes("facts_v") + "SELECT 'mem_fact_' || a.id AS from_memory_id, 'mem_fact_' || b.id AS to_memory_id, 'updates' AS relation_type FROM facts_v a JOIN facts_v b ON a.supersedes = b.summary_id AND a.scope_owner = b.scope_owner WHERE a.id % 3 <> 0")
def relation_record(t):
    """Every version's fact updates the one before; every third text is paraphrased and skipped."""
    f = facts(t)
    old = f.select(*SCOPE, F.col("summary_id").alias("to_summary"), F.col("fact").alias("to_fact"))
    text = F.when(F.col("id") % 3 == 0, F.concat("fact", F.lit("!"))).otherwise(F.col("fact"))
    p = f.filter("supersedes is not null").select(*SCOPE, F.col("summary_id").alias("from_summary"), text.alias("from_fact"), F.col("supersedes").alias("to_summary"), F.lit("updates").alias("relation_type"))
    return consolidate.relation_record(p.join(old, [*SCOPE, "to_summary"]), f).select("from_memory_id", "to_memory_id", "relation_type")


_SPEC = """cs AS (SELECT id, created_at, entities_touched FROM current_v), ex AS (SELECT id, created_at, unnest(entities_touched) AS e FROM cs), fq AS (SELECT e, count(*) AS f FROM ex GROUP BY 1),
 tr AS (SELECT DISTINCT id, unnest(entities_touched) AS e FROM summaries_v WHERE correction_reason IS NOT NULL),
 sc AS (SELECT tr.id AS query_id, ex.id AS doc_id, any_value(ex.created_at) AS created_at, round(sum(1.0::DOUBLE / f), 9) AS score FROM tr JOIN ex ON ex.e = tr.e AND ex.id <> tr.id JOIN fq ON fq.e = tr.e GROUP BY tr.id, ex.id)"""


@query("entity_specificity", ctes("current_v", more=_SPEC) + "SELECT query_id, doc_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, doc_id) AS rank FROM sc) WHERE rank <= 5")
def entity_specificity(t):
    """Corrected versions ask for the related current ones, all customers in one shared scope."""
    s = summaries(t).select(F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner"), "id", "supersedes", "created_at", "entities_touched", "correction_reason")
    s = materialize(s, "summaries")
    r = consolidate.entity_specificity(s, s.filter("correction_reason is not null"))
    return r.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("current_content", ctes("current_v", "facts_v") + """SELECT c.id, '{"summary":{"summary":"' || c.part_id || '"},"key_facts":[{"fact":"' || f.fact || '","source_count":' || f.source_count || '}],"entities_touched":[{"id":"' || c.part_id || '","kind":"project","name":"' || p_name
 || '","attributes":{"brand":"' || p_brand || '"}},{"id":"' || c.supplier_id || '","kind":"organization","name":"' || s_name || '"}]}' AS document FROM current_v c JOIN facts_v f ON f.summary_id = c.id JOIN part ON p_partkey = c.part JOIN supplier ON s_suppkey = c.supp""")
def current_content(t):
    s = summaries(t).withColumn("scope_kind", F.lit("shared")).withColumn("scope_owner", F.lit("team:all")).withColumn("summary", F.col("part_id"))
    scope = [F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner")]
    f = facts(t).drop(*SCOPE).select("*", *scope)
    part = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    e = t.part.select(*scope, part.alias("id"), F.lit("project").alias("kind"), F.col("p_name").alias("name")).unionByName(
        t.supplier.select(*scope, F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("organization").alias("kind"), F.col("s_name").alias("name")))
    a = t.part.select(*scope, part.alias("entity_id"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("attributes"))
    return consolidate.current_content(s, f, e, a).select("id", "document")


@query("backfill_memories", """SELECT 'mem_attr_' || substr(sha256('shared|team:all|part:' || p_partkey || '|' || CASE WHEN p_size > 40 THEN '__empty__' ELSE 'brand' END), 1, 24) AS id, p_size <= 40 AS grounded, CASE WHEN p_size > 40 THEN '' ELSE p_brand END AS content FROM part
UNION ALL SELECT 'mem_fact_' || d.doc_id, TRUE, lang FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)""")
def backfill_memories(t):
    """Parts with their brand as legacy attributes (large ones have an empty map), documents as facts."""
    from memspark.plans.maintain import backfill_memories as backfill

    scope = [F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner")]
    empty = F.create_map().cast("map<string,string>")
    attrs = F.when(F.col("p_size") > 40, empty).otherwise(F.create_map(F.lit("brand"), "p_brand"))
    e = t.part.select(*scope, F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"), attrs.alias("attributes"))
    f = t.documents.select(*scope, F.col("doc_id").alias("id"), F.lit("s").alias("summary_id"), F.col("lang").alias("fact"), F.lit(True).alias("grounded"))
    have = t.labels.select(*scope, F.concat(F.lit("mem_fact_"), F.col("doc_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("entity_id"), F.lit(False).alias("is_static"))
    return backfill(e, f, have).select("id", "grounded", "content")
