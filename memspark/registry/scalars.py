"""Scalar expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import crypto as C
from memspark.functions import text as X
from memspark.functions import timeex as D
from memspark.functions import vectors as V
from memspark.operators.fusion import match_label, reciprocal_rank
from memspark.registry import query
from memspark.registry.views import AS_OF, as_of, ctes, entities, episodes, queries, sql_tokens

TOK = sql_tokens("text", X.STOP_WORDS)
THEME = sql_tokens("text", X.THEME_STOP_WORDS)


def any_sql(expr, phrases):
    return "(" + " OR ".join(f"contains({expr}, '{p}')" for p in phrases) + ")"


@query("tokenize", f"SELECT doc_id, len(tok)::INTEGER AS n_tokens, md5(array_to_string(tok, ' ')) AS digest FROM (SELECT doc_id, {TOK} AS tok FROM documents)")
def tokenize(t):
    d = t.documents.select("doc_id", X.tokenize(F.col("text")).alias("tok"))
    return d.select("doc_id", F.size("tok").alias("n_tokens"), F.md5(F.array_join("tok", " ")).alias("digest"))


@query("theme_tokens", f"SELECT doc_id, len(tok)::INTEGER AS n_tokens, md5(array_to_string(tok, ' ')) AS digest FROM (SELECT doc_id, {THEME} AS tok FROM documents)")
def theme_tokens(t):
    d = t.documents.select("doc_id", X.theme_tokens(F.col("text")).alias("tok"))
    return d.select("doc_id", F.size("tok").alias("n_tokens"), F.md5(F.array_join("tok", " ")).alias("digest"))


@query("token_set_jaccard", f"""WITH s AS (SELECT conv_id, turn, list_distinct({TOK}) AS toks FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.toks) = 0 OR len(b.toks) = 0 THEN 0.0
 ELSE len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) END, 6) AS overlap
FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn""")
def token_set_jaccard(t):
    s = t.conversations.select("conv_id", "turn", X.token_set(F.col("text")).alias("toks"))
    nxt = s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("toks").alias("next"))
    return s.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.round(X.jaccard(F.col("toks"), F.col("next")), 6).alias("overlap"))


@query("cosine", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id""")
def cosine(t):
    a = t.embeddings.select("vec_id", "embedding")
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("sim"))


@query("vector_mean", """SELECT label, i::INTEGER AS position, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x,
 generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i""")
def vector_mean(t):
    m = V.vector_mean(t.embeddings, ["label"], "embedding", 64)
    return m.select("label", F.posexplode("mean").alias("position", "mean")).withColumn("mean", F.round("mean", 6))


@query("vector_pad", """SELECT vec_id, (len(embedding) + 36)::INTEGER AS dims, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings""")
def vector_pad(t):
    p = t.embeddings.select("vec_id", V.pad(F.col("embedding"), 100).alias("v"))
    total = F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return p.select("vec_id", F.size("v").alias("dims"), F.round(total, 4).alias("total"))


@query("reciprocal_rank", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1.0 / (1.0 + l_linenumber + 1), 6) AS weight FROM lineitem")
def reciprocal(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(reciprocal_rank(F.col("l_linenumber")), 6).alias("weight"))


_EXCHANGE = """WITH x AS (SELECT a.conv_id, a.turn, a.text AS input_text, b.text AS output_text FROM conversations a
 JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn WHERE a.role = 'user' AND b.role = 'assistant')
"""


def exchanges(t):
    a = t.conversations.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("input_text"))
    b = t.conversations.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output_text"))
    return a.join(b, ["conv_id", "turn"])


_QX = ctes("queries_v")
_HITS = " + ".join(f"CASE WHEN contains(lower(text || ' ' || text), '{p}') THEN 0.1::DOUBLE ELSE 0 END" for p in X.IMPORTANT_PHRASES)


@query("importance_score", f"""{_QX}SELECT query_id, round(least(1.0::DOUBLE, 0.2::DOUBLE + {_HITS} + CASE WHEN contains(text, '?') THEN 0.05::DOUBLE ELSE 0 END), 6) AS importance FROM queries_v""")
def importance_score(t):
    return queries(t).select("query_id", F.round(X.importance_score(F.col("text"), F.col("text")), 6).alias("importance"))


@query("content_hash", _EXCHANGE + "SELECT conv_id, turn, 'sha256:' || sha256(input_text || chr(0) || output_text) AS hash FROM x")
def content_hash(t):
    return exchanges(t).select("conv_id", "turn", X.content_hash(F.col("input_text"), F.col("output_text")).alias("hash"))


@query("episode_id", """SELECT event_id, 'ep_' || lpad((epoch_us(ts) // 1000)::VARCHAR, 13, '0') || substr(sha256(user_id || '|' || event_id), 1, 20) AS id FROM events""")
def episode_id(t):
    return t.events.select("event_id", X.episode_id(F.col("ts"), F.col("user_id"), F.col("event_id")).alias("id"))


@query("attribute_memory_id", """SELECT p_partkey, 'mem_attr_' || substr(sha256('shared|team:all|part:' || p_partkey || '|brand'), 1, 24) AS attr_id,
 'mem_fact_' || p_partkey AS fact_id FROM part""")
def attribute_memory_id(t):
    ent = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    return t.part.select("p_partkey", X.attribute_memory_id(F.lit("shared"), F.lit("team:all"), ent, F.lit("brand")).alias("attr_id"), X.fact_memory_id(F.col("p_partkey")).alias("fact_id"))


_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


@query("slugify", f"SELECT c_custkey, {_SLUG.format('c_name')} AS slug FROM customer")
def slugify(t):
    return t.customer.select("c_custkey", X.slugify(F.col("c_name")).alias("slug"))


@query("entity_id", f"""WITH w AS (SELECT doc_id, lang, text AS w FROM documents)
SELECT doc_id, CASE WHEN {_SLUG.format('w')} = '' THEN 'doc-' || doc_id ELSE 'place:' || {_SLUG.format('w')} END AS id FROM w""")
def entity_id(t):
    return t.documents.select("doc_id", X.entity_id(F.lit("place"), F.col("text"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).alias("id"))


@query("slug_part", ctes("entities_v") + "SELECT id, substr(id, instr(id, ':') + 1) AS slug FROM entities_v")
def slug_part(t):
    return entities(t).select("id", X.slug_part(F.col("id")).alias("slug"))


@query("predicate_norm", """WITH s AS (SELECT doc_id, unnest(string_split(text, '.')) AS said, generate_subscripts(string_split(text, '.'), 1) - 1 AS pos FROM documents),
 p AS (SELECT doc_id, pos, CASE WHEN doc_id % 3 = 0 THEN 'person' ELSE 'place' END AS kind,
 CASE WHEN doc_id % 5 = 0 AND pos = 0 THEN ' Based_In ' ELSE said END AS raw FROM s),
 q AS (SELECT doc_id, pos, kind, lower(regexp_replace(raw, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS p FROM p)
SELECT doc_id, pos, CASE WHEN strlen(p) > 64 THEN '' WHEN kind = 'person' AND p = 'based_in' THEN 'lives_in' ELSE p END AS predicate FROM q""")
def predicate_norm(t):
    """Every sentence of a document as a predicate, the first of every fifth document in an old spelling."""
    kind = F.when(F.col("doc_id") % 3 == 0, "person").otherwise("place")
    said = t.documents.select("doc_id", F.posexplode(F.split("text", r"\.")).alias("pos", "said"))
    raw = F.when((F.col("doc_id") % 5 == 0) & (F.col("pos") == 0), " Based_In ").otherwise(F.col("said"))
    return said.select("doc_id", F.col("pos").cast("long").alias("pos"), X.predicate_norm(kind, raw).alias("predicate"))


@query("optional_date", """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
 WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-') || '31' ELSE '' END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN regexp_full_match(raw, '\\d{4}-\\d{2}-\\d{2}') THEN TRY_CAST(raw AS DATE) END AS day FROM r""")
def optional_date(t):
    m = F.col("o_orderkey") % 4
    raw = (
        F.when(m == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(m == 1, F.date_format("o_orderdate", "yyyy/MM/dd"))
        .when(m == 2, F.concat(F.date_format("o_orderdate", "yyyy-MM-"), F.lit("31"))).otherwise("")
    )
    return t.orders.select("o_orderkey", X.optional_date(raw).alias("day"))


_KEYS = """WITH k AS (SELECT event_id, ts::DATE AS day, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m')
 WHEN 2 THEN lpad(isoyear(ts)::VARCHAR, 4, '0') || '-W' || lpad(week(ts)::VARCHAR, 2, '0') WHEN 3 THEN strftime(ts, '%Y') ELSE 'soon' END AS period FROM events),
 r AS (SELECT event_id, period, CASE WHEN event_id % 5 = 0 THEN day WHEN event_id % 5 = 1 THEN date_trunc('month', day)::DATE
 WHEN event_id % 5 = 2 THEN date_trunc('week', day)::DATE WHEN event_id % 5 = 3 THEN date_trunc('year', day)::DATE END AS range_start,
 CASE WHEN event_id % 5 = 0 THEN day + 1 WHEN event_id % 5 = 1 THEN (date_trunc('month', day) + INTERVAL 1 MONTH)::DATE
 WHEN event_id % 5 = 2 THEN date_trunc('week', day)::DATE + 7 WHEN event_id % 5 = 3 THEN (date_trunc('year', day) + INTERVAL 1 YEAR)::DATE END AS range_end FROM k)
"""


def period_strings(t):
    m, day = F.col("event_id") % 5, F.to_date("ts")
    period = (
        F.when(m == 0, D.period_key(day, "daily")).when(m == 1, D.period_key(day, "monthly")).when(m == 2, D.period_key(day, "weekly"))
        .when(m == 3, D.period_key(day, "yearly")).otherwise("soon")
    )
    return t.events.select("event_id", period.alias("period"))


@query("period_range", _KEYS + "SELECT event_id, period, range_start, range_end FROM r")
def period_range(t):
    r = period_strings(t).withColumn("r", D.period_range(F.col("period")))
    return r.select("event_id", "period", F.col("r.start").alias("range_start"), F.col("r.end").alias("range_end"))


@query("period_as_of", _KEYS + "SELECT event_id, range_end - 1 AS as_of FROM r")
def period_as_of(t):
    return period_strings(t).select("event_id", D.period_as_of(F.col("period")).alias("as_of"))


@query("period_key", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS daily,
 lpad(isoyear(o_orderdate)::VARCHAR, 4, '0') || '-W' || lpad(week(o_orderdate)::VARCHAR, 2, '0') AS weekly,
 strftime(o_orderdate, '%Y-%m') AS monthly, strftime(o_orderdate, '%Y') AS yearly FROM orders""")
def period_key(t):
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", *[D.period_key(day, lv).alias(lv) for lv in ("daily", "weekly", "monthly", "yearly")])


@query("periods_overlap", """SELECT event_id, ts::DATE < DATE '2024-01-15' AND DATE '2024-01-08' < ts::DATE + 1 AS hit FROM events""")
def periods_overlap(t):
    day = F.to_date("ts")
    s, e = F.lit("2024-01-08").cast("date"), F.lit("2024-01-15").cast("date")
    return t.events.select("event_id", D.overlaps(day, F.date_add(day, 1), s, e).alias("hit"))


TF_SQL = """CASE WHEN contains(l, 'yesterday') THEN [d - 1, d] WHEN contains(l, 'today') THEN [d, d + 1]
 WHEN contains(l, 'last week') THEN [w - 7, w] WHEN contains(l, 'this week') THEN [w, w + 7]
 WHEN contains(l, 'last month') THEN [(m - INTERVAL 1 MONTH)::DATE, m] WHEN contains(l, 'this month') THEN [m, (m + INTERVAL 1 MONTH)::DATE]
 WHEN contains(l, 'last year') THEN [(y - INTERVAL 1 YEAR)::DATE, y] WHEN contains(l, 'this year') THEN [y, (y + INTERVAL 1 YEAR)::DATE] END"""
TF_CTE = f"""tf_v AS (SELECT query_id, text, tf[1] AS tf_start, tf[2] AS tf_end FROM (SELECT query_id, text, {TF_SQL} AS tf FROM
 (SELECT query_id, text, lower(text) AS l, TIMESTAMP '{AS_OF}'::DATE AS d, date_trunc('week', TIMESTAMP '{AS_OF}')::DATE AS w,
 date_trunc('month', TIMESTAMP '{AS_OF}')::DATE AS m, date_trunc('year', TIMESTAMP '{AS_OF}')::DATE AS y FROM queries_v)))"""


@query("resolve_timeframe", ctes("queries_v", more=TF_CTE) + "SELECT query_id, tf_start, tf_end FROM tf_v")
def resolve_timeframe(t):
    q = queries(t).withColumn("tf", D.resolve_timeframe(F.col("text"), as_of()))
    return q.select("query_id", F.col("tf.start").alias("tf_start"), F.col("tf.end").alias("tf_end"))


def label_sql(start: str, now: str, wording: str) -> str:
    def unit(n, u):
        return f"CASE WHEN greatest({n}::BIGINT, 1) = 1 THEN '1 {u} {wording}' ELSE greatest({n}::BIGINT, 1) || ' {u}s {wording}' END"

    d = f"trunc((epoch_us({now}) - epoch_us({start})) / 86400e6)::BIGINT"
    return f"""CASE WHEN {d} < 0 THEN '' WHEN {d} = 0 THEN 'today' WHEN {d} < 7 THEN {unit(d, 'day')}
 WHEN {d} < 60 THEN {unit(f'round({d} / 7)', 'week')} WHEN round({d} / 30.44::DOUBLE) < 12 THEN {unit(f'round({d} / 30.44::DOUBLE)', 'month')}
 ELSE {unit(f'round({d} / 365.25::DOUBLE)', 'year')} END"""


@query("relative_date_label", f"SELECT o_orderkey, {label_sql('o_orderdate', 'TIMESTAMP ' + chr(39) + '2000-03-01 12:00:00' + chr(39), 'before now')} AS label FROM orders")
def relative_date_label(t):
    now = F.lit("2000-03-01 12:00:00").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", D.relative_date_label(F.col("o_orderdate"), now).alias("label"))


@query("relative_delta_ago", f"SELECT event_id, {label_sql('ts', 'TIMESTAMP ' + chr(39) + AS_OF + chr(39), 'ago')} AS label FROM events")
def relative_delta_ago(t):
    return t.events.select("event_id", D.relative_delta_ago(F.col("ts"), as_of()).alias("label"))


@query("truncate_budget", """SELECT doc_id, md5(CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || chr(10) || '...[truncated to fit context budget]' ELSE text END) AS cut FROM documents""")
def truncate_budget(t):
    return t.documents.select("doc_id", F.md5(X.truncate_budget(F.col("text"), 2000)).alias("cut"))


@query("hard_truncate", "SELECT doc_id, substr(text, 1, 220) AS cut FROM documents")
def hard_truncate(t):
    return t.documents.select("doc_id", X.hard_truncate(F.col("text"), 220).alias("cut"))


@query("centered_excerpt", _EXCHANGE + f""", t AS (SELECT conv_id, turn, 'USER: ' || input_text || ' ASSISTANT: ' || output_text AS t, {sql_tokens('input_text', X.STOP_WORDS)} AS terms FROM x),
 p AS (SELECT conv_id, turn, t, flatten(list_transform(terms, lambda w: list_transform(range(1, len(string_split(lower(t), w))),
   lambda j: (list_sum(list_transform(string_split(lower(t), w)[1:j], lambda s: length(s))) + (j - 1) * length(w))::BIGINT))) AS ps FROM t),
 n AS (SELECT *, list_transform(ps, lambda a: len(list_filter(ps, lambda b: abs(b - a) <= 200))) AS ns FROM p),
 b AS (SELECT *, greatest(0, least(greatest(0, ps[list_position(ns, list_max(ns))] - 200), length(t) - 400)) AS st FROM n)
SELECT conv_id, turn, CASE WHEN length(t) <= 400 THEN t WHEN len(ps) = 0 THEN substr(t, 1, 400)
 ELSE CASE WHEN st > 0 THEN '...[excerpt] ' ELSE '' END || substr(t, st + 1, 400) || CASE WHEN st + 400 < length(t) THEN ' ...[truncated]' ELSE '' END END AS excerpt FROM b""")
def centered_excerpt(t):
    x = exchanges(t)
    text = F.concat(F.lit("USER: "), "input_text", F.lit(" ASSISTANT: "), "output_text")
    return x.select("conv_id", "turn", X.centered_excerpt(text, X.tokenize(F.col("input_text")), 400).alias("excerpt"))


@query("chunk_text", """WITH n AS (SELECT doc_id, text, unnest(range(0, greatest(1, ceil(length(text) / 4000.0))::BIGINT)) AS i FROM documents)
SELECT doc_id, i::INTEGER AS chunk_no, md5(substr(text, i * 4000 + 1, 4000)) AS chunk FROM n""")
def chunk_text(t):
    c = t.documents.select("doc_id", F.posexplode(X.chunk_text(F.col("text"))).alias("chunk_no", "chunk"))
    return c.withColumn("chunk", F.md5("chunk"))


@query("embed_truncate", "SELECT doc_id, length(substr(text, 1, 20000))::INTEGER AS n_chars, md5(substr(text, 1, 4000)) AS fact_cut FROM documents")
def embed_truncate(t):
    c = F.col("text")
    return t.documents.select("doc_id", F.length(X.embed_truncate(c)).alias("n_chars"), F.md5(X.embed_truncate(c, X.FACT_EMBED_CHARS)).alias("fact_cut"))


@query("episode_text", _EXCHANGE + "SELECT conv_id, turn, 'USER: ' || input_text || chr(10) || 'ASSISTANT: ' || output_text AS block FROM x")
def episode_text(t):
    return exchanges(t).select("conv_id", "turn", X.episode_text(F.col("input_text"), F.col("output_text")).alias("block"))


@query("entity_text", """SELECT p_partkey, p_name || ' (project)' || chr(10) || 'brand: ' || p_brand || chr(10) || 'size: ' || p_size || chr(10) || 'type: ' || p_type AS block FROM part""")
def entity_text(t):
    attrs = F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand", F.lit("size"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", X.entity_text(F.lit("project"), F.col("p_name"), attrs).alias("block"))


@query("source_block", _EXCHANGE + """SELECT conv_id, turn, '--- id: ep_' || conv_id || '_' || turn || CASE WHEN conv_id % 2 = 0 THEN ' (date: 2024-01-0' || (turn + 1) || ')' ELSE '' END
 || ' ---' || chr(10) || output_text || chr(10) || chr(10) AS block FROM x""")
def source_block(t):
    ident = F.concat(F.lit("ep_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    date = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("2024-01-0"), (F.col("turn") + 1).cast("string")))
    return exchanges(t).select("conv_id", "turn", X.source_block(ident, date, F.col("output_text")).alias("block"))


@query("first_json_object", "SELECT event_id, props AS found FROM events")
def first_json_object(t):
    noisy = F.concat(F.lit("verdict: "), "props", F.lit(" (see {above})"))
    return t.events.select("event_id", X.first_json_object(noisy).alias("found"))


@query("json_string_map", """SELECT event_id, 'a' || (props::JSON ->> '$.k') AS word, (props::JSON ->> '$.k') AS number, '{"k":' || (props::JSON ->> '$.k') || '}' AS nested FROM events""")
def json_string_map(t):
    k = F.get_json_object("props", "$.k")
    doc = F.concat(F.lit('{"word": "a'), k, F.lit('", "number": '), k, F.lit(', "nested": {"k":'), k, F.lit("}}"))
    m = t.events.select("event_id", X.json_string_map(doc).alias("m"))
    return m.select("event_id", F.col("m")["word"].alias("word"), F.col("m")["number"].alias("number"), F.col("m")["nested"].alias("nested"))


@query("normalize_tags", """WITH r AS (SELECT doc_id, [' ' || upper(lang) || ' ', source, lang, '', 'mcp', CASE WHEN doc_id % 7 = 0 THEN 'bad tag!' ELSE source END] AS raw FROM documents),
 c AS (SELECT doc_id, list_filter(list_transform(raw, lambda x: lower(trim(x))), lambda x: x <> '' AND x <> 'mcp') AS tags FROM r)
SELECT doc_id, len(list_filter(tags, lambda x: NOT regexp_matches(x, '^[a-z0-9][a-z0-9_.:-]*$'))) = 0 AS valid,
 CASE WHEN len(list_filter(tags, lambda x: NOT regexp_matches(x, '^[a-z0-9][a-z0-9_.:-]*$'))) = 0 THEN tags[1] || ',' || tags[2] END AS tags FROM c""")
def normalize_tags(t):
    odd = F.when(F.col("doc_id") % 7 == 0, F.lit("bad tag!")).otherwise(F.col("source"))
    raw = F.array(F.concat(F.lit(" "), F.upper("lang"), F.lit(" ")), "source", "lang", F.lit(""), F.lit("mcp"), odd)
    n = t.documents.select("doc_id", X.normalize_tags(raw, ["mcp"]).alias("n"))
    return n.select("doc_id", "n.valid", F.array_join("n.tags", ",").alias("tags"))


@query("escape_like", r"""SELECT page_id, regexp_replace(url || '_100%\', '([\\%_])', '\\\1', 'g') AS escaped FROM pages""")
def escape_like(t):
    return t.pages.select("page_id", X.escape_like(F.concat("url", F.lit("_100%\\"))).alias("escaped"))


@query("search_tier", ctes("episodes_v") + """SELECT scope_kind, scope_owner, count(*) AS total, CASE WHEN count(*) > 60 THEN 'disabled' WHEN count(*) > 40 THEN 'narrowed' ELSE 'full' END AS tier
FROM episodes_v GROUP BY scope_kind, scope_owner""")
def search_tier(t):
    from memspark.operators.panels import search_tier as tier

    n = episodes(t).groupBy("scope_kind", "scope_owner").agg(F.count(F.lit(1)).alias("total"))
    return n.withColumn("tier", tier(F.col("total"), narrow=40, disable=60))


@query("match_label", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'R' AND l_linestatus = 'O' THEN ', vector+keyword match' WHEN l_linestatus = 'O' THEN ', keyword match' ELSE '' END AS label FROM lineitem")
def label(t):
    vec = F.when(F.col("l_returnflag") != "R", F.lit(1))
    kw = F.when(F.col("l_linestatus") == "O", F.lit(1))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", match_label(vec, kw).alias("label"))


_I = f"""{_QX}SELECT query_id, {any_sql('lower(text)', X.RECOMMENDATION_PHRASES)} AS recommendation, {any_sql('lower(text)', X.ORDERING_PHRASES)} AS ordering,
 contains(lower(text), 'how many') AND NOT {any_sql('lower(text)', X.COUNTING_EXCLUDED)} AS counting, {any_sql('lower(text)', X.CONSECUTIVE_PHRASES)} AS consecutive FROM queries_v"""


@query("intent_flags", _I)
def intent_flags(t):
    c = F.col("text")
    return queries(t).select("query_id", X.recommendation_intent(c).alias("recommendation"), X.ordering_intent(c).alias("ordering"), X.counting_intent(c).alias("counting"), X.consecutive_intent(c).alias("consecutive"))


ORDERING_SQL, RECOMMEND_SQL = any_sql("lower(text)", X.ORDERING_PHRASES), any_sql("lower(text)", X.RECOMMENDATION_PHRASES)
SIGNAL_SQL = f"({any_sql('lower(text)', X.SIGNAL_PHRASES)} OR (trim(text) <> '' AND (trim(text) LIKE '%?' OR regexp_matches(lower(trim(text)), '^({'|'.join(X.QUESTION_STARTERS)})( |$)'))))"


@query("stage1_signal", f"{_QX}SELECT query_id, {SIGNAL_SQL} AS signal FROM queries_v")
def stage1_signal(t):
    return queries(t).select("query_id", X.search_signal(F.col("text")).alias("signal"))


@query("field_crypto", "SELECT conv_id, turn, md5(text) AS plain, TRUE AS hidden FROM conversations")
def field_crypto(t):
    """Encrypt and decrypt every text under its conversation's key; the cipher text differs from the plain."""
    key = F.unhex(F.sha2(F.concat(F.lit("key|"), F.col("conv_id").cast("string")), 256))
    enc = t.conversations.select("conv_id", "turn", "text", key.alias("key"), C.encrypt(F.col("text"), key).alias("secret"))
    return enc.select("conv_id", "turn", F.md5(C.decrypt(F.col("secret"), F.col("key"))).alias("plain"), (F.col("secret") != F.col("text").cast("binary")).alias("hidden"))


@query("secret_scan", f"""SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, p in X.SECRET_PATTERNS.items())} END AS kind FROM documents""")
def secret_scan(t):
    return t.documents.select("doc_id", X.secret_kind(F.col("text")).alias("kind"))


@query("text_repair", "SELECT doc_id, doc_id % 3 <> 0 AS accepted, CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS digest FROM documents")
def text_repair(t):
    """Whole documents as bytes; every third is broken by as many stray bytes as it has characters."""
    broken = F.concat(F.col("text").cast("binary"), F.unhex(F.repeat(F.lit("FF41"), F.length("text"))))
    raw = F.when(F.col("doc_id") % 3 == 0, broken).otherwise(F.col("text").cast("binary"))
    r = t.documents.select("doc_id", X.repair_text(raw).alias("r"))
    return r.select("doc_id", "r.accepted", F.md5("r.text").alias("digest"))


@query("parse_chat_dates", "SELECT event_id, date_trunc('minute', ts) AS spoken, date_trunc('minute', ts) AS slashed, NULL::TIMESTAMP AS broken FROM events")
def parse_chat_dates(t):
    spoken = F.concat(F.lower(F.date_format("ts", "h:mm a")), F.date_format("ts", " 'on' d MMMM, yyyy"))
    slashed = F.date_format("ts", "yyyy/MM/dd (EEE) HH:mm")
    return t.events.select(
        "event_id", D.parse_spoken_date(spoken).cast("timestamp_ntz").alias("spoken"),
        D.parse_slash_date(slashed).cast("timestamp_ntz").alias("slashed"), D.parse_spoken_date(slashed).cast("timestamp_ntz").alias("broken"),
    )
