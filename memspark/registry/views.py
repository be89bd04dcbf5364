"""The given tables seen as memory tables, once as DataFrames and once as SQL text.

Every view reads whole tables. ``AS_OF`` stands for "now".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.registry import Tables

AS_OF = "2024-01-31 12:00:00"
ORDERS_AS_OF = "2001-09-01"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def episodes(t: Tables) -> DataFrame:
    """Events as turns: scope is the user."""
    e = t.events
    kind = F.when(F.col("event_type").isin("view", "click", "purchase"), "interaction").when(
        F.col("event_type") == "error", "feedback").otherwise("note")
    return e.select(
        F.concat(F.lit("ep_"), F.col("event_id").cast("string")).alias("id"), "ts", kind.alias("type"),
        F.round(F.least(F.col("value") / 100, F.lit(1.0)), 4).alias("importance"),
        F.lit("private").alias("scope_kind"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("scope_owner"),
        "event_id", "user_id", "event_type", "value", "props",
    )


def summaries(t: Tables) -> DataFrame:
    """Line items as versions of an order's digest: scope is the customer, period the order day."""
    # dealt by order once, for versions and for the join
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity").repartition("l_orderkey")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_shipdate").alias("created_at"), F.max("l_partkey").alias("part"), F.max("l_suppkey").alias("supp"),
        F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("state"), F.max("l_quantity").alias("qty"),
    )
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    j = lines.join(o, lines.l_orderkey == o.o_orderkey)
    ok, ln = F.col("l_orderkey").cast("string"), F.col("l_linenumber")
    return j.select(
        F.concat(F.lit("sum_"), ok, F.lit("_v"), ln.cast("string")).alias("id"),
        F.lit("private").alias("scope_kind"), F.concat(F.lit("user:"), F.col("o_custkey").cast("string")).alias("scope_owner"),
        F.lit("daily").alias("level"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("period"),
        F.when(ln > 1, F.concat(F.lit("sum_"), ok, F.lit("_v"), (ln - 1).cast("string"))).alias("supersedes"),
        "created_at", F.when(F.col("flag") == "R", "returned").alias("correction_reason"),
        F.concat(F.lit("part:"), F.col("part").cast("string")).alias("part_id"),
        F.concat(F.lit("supplier:"), F.col("supp").cast("string")).alias("supplier_id"),
        F.col("l_orderkey").alias("order_no"), ln.alias("version"), "flag", "state", "qty", "part", "supp",
    ).withColumn("entities_touched", F.array("part_id", "supplier_id"))


def facts(t: Tables) -> DataFrame:
    """One fact per digest version."""
    s = summaries(t)
    return s.select(
        (F.col("order_no") * 10 + F.col("version")).alias("id"), F.col("id").alias("summary_id"), "scope_kind", "scope_owner",
        F.concat(F.lit("bought part "), F.col("part").cast("string"), F.lit(" from supplier "), F.col("supp").cast("string")).alias("fact"),
        (F.col("flag") != "R").alias("grounded"),
        F.when(F.col("state") == "F", F.date_add(F.to_date("created_at"), 30)).alias("expires_at"),
        F.col("qty").cast("int").alias("source_count"), "supersedes", "period",
    )


def entities(t: Tables) -> DataFrame:
    """First words of documents as named entities of one shared workspace."""
    word = F.regexp_replace(F.split(F.col("text"), " ", 2)[0], r"[^\p{L}\p{Nd}]", "")
    d = t.documents.select("doc_id", word.alias("name")).filter(F.length("name") >= 3)
    slug = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-|-$", "")
    d = d.withColumn("id", F.concat(F.lit("project:"), slug))
    return d.groupBy("id").agg(F.min("name").alias("name"), F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).select(
        "id", F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner"), F.lit("project").alias("kind"), "name",
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("first_doc") % 31).cast("int")).alias("last_updated"), "first_doc", "n",
    )


def queries(t: Tables) -> DataFrame:
    """User turns as search queries, worded so that every intent and timeframe occurs."""
    c = t.conversations.filter(F.col("role") == "user")
    start = (F.col("conv_id") + F.col("turn")) % 6
    head = (
        F.when(start == 0, "How many times did ").when(start == 1, "Can you recommend ").when(start == 2, "What order of ")
        .when(start == 3, "We discussed ").when(start == 4, "How many days in a row ").otherwise("")
    )
    frame = F.col("conv_id") % 9
    tail = (
        F.when(frame == 0, " yesterday").when(frame == 1, " today").when(frame == 2, " last week").when(frame == 3, " this week")
        .when(frame == 4, " last month").when(frame == 5, " this month").when(frame == 6, " last year").when(frame == 7, " this year").otherwise("")
    )
    mark = F.when(F.col("turn") % 4 == 2, "?").otherwise("")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner"),
        F.concat(head, F.col("text"), tail, mark).alias("text"), "conv_id", "turn",
    )


def corpus_docs(t: Tables) -> DataFrame:
    return t.documents.select(F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner"), "doc_id", "text")


def benchmark_queries(t: Tables) -> DataFrame:
    return t.benchmark.select(F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner"), F.col("item_id").alias("query_id"), "text")


def vectors(t: Tables) -> DataFrame:
    """Embeddings with their label as scope."""
    return t.embeddings.select(
        F.lit("private").alias("scope_kind"), F.concat(F.lit("user:"), F.col("label").cast("string")).alias("scope_owner"),
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"),
    )


def preference_edges(t: Tables) -> DataFrame:
    """Per customer and order day, the preferred priority: dated edges that change over time."""
    o = t.orders.groupBy("o_custkey", F.to_date("o_orderdate").alias("valid_from")).agg(
        F.min_by("o_orderpriority", "o_orderkey").alias("priority"), F.min("o_orderkey").alias("order_no")
    )
    return o.select(
        F.lit("private").alias("scope_kind"), F.lit("user:all").alias("scope_owner"),
        F.concat(F.lit("person:"), F.col("o_custkey").cast("string")).alias("subject_id"), F.lit("prefers").alias("predicate"),
        F.concat(F.lit("preference:"), F.substring("priority", 1, 1)).alias("object_id"), "valid_from",
        (F.datediff("valid_from", F.lit("1970-01-01").cast("date")).cast("long") * 10_000_000_000 + F.col("order_no")).alias("arrival"), "order_no",
    )


def place_edges(t: Tables) -> DataFrame:
    """Customers and suppliers live in nations, nations belong to regions."""
    lit = F.lit
    scope = [lit("shared").alias("scope_kind"), lit("team:all").alias("scope_owner")]

    def edge(df, sk, s, p, ok, o):
        return df.select(
            *scope, F.concat(lit(sk), F.col(s).cast("string")).alias("subject_id"), lit(p).alias("predicate"),
            F.concat(lit(ok), F.col(o).cast("string")).alias("object_id"), lit(None).cast("date").alias("valid_until"),
        )

    return (
        edge(t.customer, "person:", "c_custkey", "lives_in", "place:n", "c_nationkey")
        .unionByName(edge(t.supplier, "organization:", "s_suppkey", "based_in", "place:n", "s_nationkey"))
        .unionByName(edge(t.nation, "place:n", "n_nationkey", "part_of", "place:r", "n_regionkey"))
    )


def place_entities(t: Tables) -> DataFrame:
    scope = [F.lit("shared").alias("scope_kind"), F.lit("team:all").alias("scope_owner")]

    def ent(df, prefix, key, name, kind):
        return df.select(*scope, F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name"))

    return (
        ent(t.customer, "person:", "c_custkey", "c_name", "person")
        .unionByName(ent(t.supplier, "organization:", "s_suppkey", "s_name", "organization"))
        .unionByName(ent(t.nation, "place:n", "n_nationkey", "n_name", "place"))
        .unionByName(ent(t.region, "place:r", "r_regionkey", "r_name", "place"))
    )


def audit_log(t: Tables) -> DataFrame:
    """Events as audit rows; ``props`` plays the target reference."""
    e = t.events
    kind = (
        F.when(F.col("event_type") == "click", "capture").when(F.col("event_type") == "view", "retrieve")
        .when(F.col("event_type") == "purchase", "export").when(F.col("event_type") == "signup", "dashboard_login").otherwise("correct")
    )
    return e.select(
        F.col("event_id").alias("id"), "ts", kind.alias("event_type"), F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("actor"),
        F.lit("private").alias("scope_kind"), F.concat(F.lit("user:"), (F.col("user_id")).cast("string")).alias("scope_owner"),
        F.col("props").alias("target_ref"), F.col("value").cast("string").alias("detail"),
    )


def sentences(t: Tables) -> DataFrame:
    """Lines of documents as facts of the document's digest."""
    d = t.documents.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "fact"))
    return d.select(
        "doc_id", F.concat(F.lit("sum_"), F.col("doc_id").cast("string")).alias("summary_id"), F.lit("private").alias("scope_kind"),
        F.concat(F.lit("user:"), "lang").alias("scope_owner"), (F.col("doc_id") * 100_000 + F.col("pos")).alias("fact_id"), "pos", "fact",
    )


# The same views as SQL.


_SQL = {
    "episodes_v": (
        (), """SELECT 'ep_' || event_id AS id, ts, CASE WHEN event_type IN ('view','click','purchase') THEN 'interaction'
 WHEN event_type = 'error' THEN 'feedback' ELSE 'note' END AS type, round(least(value / 100, 1.0), 4) AS importance,
 'private' AS scope_kind, 'user:' || user_id AS scope_owner, event_id, user_id, event_type, value, props FROM events"""),
    "summaries_v": (
        (), """SELECT 'sum_' || l_orderkey || '_v' || l_linenumber AS id, 'private' AS scope_kind, 'user:' || o_custkey AS scope_owner,
 'daily' AS level, strftime(o_orderdate, '%Y-%m-%d') AS period,
 CASE WHEN l_linenumber > 1 THEN 'sum_' || l_orderkey || '_v' || (l_linenumber - 1) END AS supersedes, created_at,
 CASE WHEN flag = 'R' THEN 'returned' END AS correction_reason, 'part:' || part AS part_id, 'supplier:' || supp AS supplier_id,
 l_orderkey AS order_no, l_linenumber AS version, flag, state, qty, part, supp, ['part:' || part, 'supplier:' || supp] AS entities_touched
 FROM (SELECT l_orderkey, l_linenumber, max(l_shipdate) AS created_at, max(l_partkey) AS part, max(l_suppkey) AS supp,
 max(l_returnflag) AS flag, max(l_linestatus) AS state, max(l_quantity) AS qty FROM lineitem GROUP BY ALL) l
 JOIN orders ON l_orderkey = o_orderkey"""),
    "current_v": (("summaries_v",), """SELECT s.* FROM summaries_v s WHERE NOT EXISTS (SELECT 1 FROM summaries_v n
 WHERE n.supersedes = s.id AND n.scope_kind = s.scope_kind AND n.scope_owner = s.scope_owner)"""),
    "facts_v": (
        ("summaries_v",), """SELECT order_no * 10 + version AS id, id AS summary_id, scope_kind, scope_owner,
 'bought part ' || part || ' from supplier ' || supp AS fact, flag <> 'R' AS grounded,
 CASE WHEN state = 'F' THEN created_at::DATE + 30 END AS expires_at, qty::INTEGER AS source_count, supersedes, period FROM summaries_v"""),
    "entities_v": (
        (), """SELECT id, 'shared' AS scope_kind, 'team:all' AS scope_owner, 'project' AS kind, min(name) AS name,
 DATE '2024-01-01' + (min(doc_id) % 31)::INTEGER AS last_updated, min(doc_id) AS first_doc, count(*) AS n
 FROM (SELECT doc_id, name, 'project:' || regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS id
 FROM (SELECT doc_id, regexp_replace(split_part(text, ' ', 1), '[^\\p{L}\\p{Nd}]', '', 'g') AS name FROM documents) WHERE length(name) >= 3)
 GROUP BY id"""),
    "queries_v": (
        (), """SELECT conv_id * 100 + turn AS query_id, 'shared' AS scope_kind, 'team:all' AS scope_owner,
 CASE (conv_id + turn) % 6 WHEN 0 THEN 'How many times did ' WHEN 1 THEN 'Can you recommend ' WHEN 2 THEN 'What order of '
 WHEN 3 THEN 'We discussed ' WHEN 4 THEN 'How many days in a row ' ELSE '' END || text ||
 CASE conv_id % 9 WHEN 0 THEN ' yesterday' WHEN 1 THEN ' today' WHEN 2 THEN ' last week' WHEN 3 THEN ' this week'
 WHEN 4 THEN ' last month' WHEN 5 THEN ' this month' WHEN 6 THEN ' last year' WHEN 7 THEN ' this year' ELSE '' END ||
 CASE WHEN turn % 4 = 2 THEN '?' ELSE '' END AS text, conv_id, turn FROM conversations WHERE role = 'user'"""),
    "prefs_v": (
        (), """SELECT 'private' AS scope_kind, 'user:all' AS scope_owner, 'person:' || o_custkey AS subject_id, 'prefers' AS predicate,
 'preference:' || substr(arg_min(o_orderpriority, o_orderkey), 1, 1) AS object_id, o_orderdate::DATE AS valid_from, min(o_orderkey) AS order_no
 FROM orders GROUP BY o_custkey, o_orderdate::DATE"""),
    "place_edges_v": (
        (), """SELECT 'person:' || c_custkey AS subject_id, 'lives_in' AS predicate, 'place:n' || c_nationkey AS object_id FROM customer
 UNION ALL SELECT 'organization:' || s_suppkey, 'based_in', 'place:n' || s_nationkey FROM supplier
 UNION ALL SELECT 'place:n' || n_nationkey, 'part_of', 'place:r' || n_regionkey FROM nation"""),
    "place_entities_v": (
        (), """SELECT 'person:' || c_custkey AS id, 'person' AS kind, c_name AS name FROM customer
 UNION ALL SELECT 'organization:' || s_suppkey, 'organization', s_name FROM supplier
 UNION ALL SELECT 'place:n' || n_nationkey, 'place', n_name FROM nation
 UNION ALL SELECT 'place:r' || r_regionkey, 'place', r_name FROM region"""),
    "audit_v": (
        (), """SELECT event_id AS id, ts, CASE event_type WHEN 'click' THEN 'capture' WHEN 'view' THEN 'retrieve' WHEN 'purchase' THEN 'export'
 WHEN 'signup' THEN 'dashboard_login' ELSE 'correct' END AS event_type, 'user:' || user_id AS actor, 'private' AS scope_kind,
 'user:' || user_id AS scope_owner, props AS target_ref, value AS detail FROM events"""),
    "sentences_v": (
        (), """SELECT doc_id, 'sum_' || doc_id AS summary_id, 'private' AS scope_kind, 'user:' || lang AS scope_owner,
 doc_id * 100000 + pos AS fact_id, pos, fact FROM (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS fact,
 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"""),
}


def sql_list(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


def sql_tokens(expr: str, stop) -> str:
    return (
        f"list_filter(string_split_regex(lower({expr}), '[^\\p{{L}}\\p{{Nd}}]+'), "
        f"lambda w: strlen(w) >= 2 AND NOT list_contains({sql_list(stop)}, w))"
    )


def ctes(*names: str, recursive: bool = False, more: str = "") -> str:
    """``WITH`` clause of the named views, after the views they need."""
    order: list[str] = []

    def add(n):
        for d in _SQL[n][0]:
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({_SQL[n][1]})" for n in order]
    if more:
        parts.append(more)
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"
