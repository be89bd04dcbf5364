"""Maintenance jobs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import crypto as C
from memspark.functions.vectors import hash_embed
from memspark.operators.scope import SCOPE
from memspark.operators.search import pending_model
from memspark.plans import maintain
from memspark.registry import query
from memspark.registry.filters import _MODELS, with_models
from memspark.registry.views import as_of, ctes, episodes


@query("reembed_job", f"SELECT vec_id, 64 AS dims, 'new:b' AS embedding_model FROM (SELECT vec_id, {_MODELS} AS m FROM embeddings) WHERE m IS DISTINCT FROM 'new:b'")
def reembed_job(t):
    """Vectors of another model, or of none, get one of the current model from their document's text."""
    todo = pending_model(with_models(t), "new:b").drop("embedding")
    docs = t.documents.select(F.col("doc_id").alias("vec_id"), "text")
    text = F.coalesce("text", F.concat(F.lit("vector "), F.col("vec_id").cast("string")))
    out = maintain.reembed(todo.join(docs, "vec_id", "left"), text, hash_embed(64), "new:b", ["vec_id"])
    return out.select("vec_id", F.size("embedding").alias("dims"), "embedding_model")


def key_table(t):
    """Two key versions per conversation."""
    owner = F.concat(F.lit("user:"), F.col("conv_id").cast("string"))
    c = t.conversations.select("conv_id").distinct().withColumn("key_version", F.explode(F.array(F.lit(1), F.lit(2))))
    key = F.unhex(F.sha2(F.concat_ws("|", F.lit("key"), "conv_id", "key_version"), 256))
    return c.select(F.lit("private").alias("scope_kind"), owner.alias("scope_owner"), "key_version", key.alias("key"))


@query("rekey_job", "SELECT conv_id, turn, 2 AS key_version, md5(text) AS plain FROM conversations")
def rekey_job(t):
    """Every turn from key one to key two; two thirds of the turns are done already and stay."""
    keys = key_table(t)
    v = F.when(F.col("turn") % 3 == 0, 1).otherwise(2)
    c = t.conversations.select(F.lit("private").alias("scope_kind"), F.concat(F.lit("user:"), F.col("conv_id").cast("string")).alias("scope_owner"), "conv_id", "turn", "text", v.alias("key_version"))
    secret = C.with_key(c, keys).withColumn("secret", C.encrypt(F.col("text"), F.col("key"))).drop("key", "text")
    goal = keys.groupBy(*SCOPE).agg(F.max("key_version").alias("target"))
    moved = maintain.rekey(secret, keys, ["secret"], goal)
    return C.with_key(moved, keys).select("conv_id", "turn", "key_version", F.md5(C.decrypt(F.col("secret"), F.col("key"))).alias("plain"))


@query("rekey_progress", "SELECT 'conversations' AS tbl, 'user:' || conv_id AS scope_owner, count(*) FILTER (turn % 3 = 0) AS n_left FROM conversations GROUP BY conv_id")
def rekey_progress(t):
    v = F.when(F.col("turn") % 3 == 0, 1).otherwise(2)
    c = t.conversations.select(F.lit("private").alias("scope_kind"), F.concat(F.lit("user:"), F.col("conv_id").cast("string")).alias("scope_owner"), v.alias("key_version"))
    goal = key_table(t).groupBy(*SCOPE).agg(F.max("key_version").alias("target"))
    return maintain.rekey_progress({"conversations": c}, goal).select("tbl", "scope_owner", "n_left")


@query("unused_key_versions", "SELECT 'user:' || conv_id AS scope_owner, 1 AS key_version FROM conversations GROUP BY conv_id HAVING count(*) FILTER (turn % 3 = 1 AND turn > 1) = 0")
def unused_key_versions(t):
    v = F.when((F.col("turn") % 3 == 1) & (F.col("turn") > 1), 1).otherwise(2)
    c = t.conversations.select(F.lit("private").alias("scope_kind"), F.concat(F.lit("user:"), F.col("conv_id").cast("string")).alias("scope_owner"), v.alias("key_version"))
    return maintain.unused_key_versions(key_table(t), [c]).select("scope_owner", "key_version")


_SWEEP = """s AS (SELECT user_id, min(ts) AS created_at, min(ts) + to_days((5 + user_id % 30)::INTEGER) AS expires_at FROM events WHERE event_type = 'signup' GROUP BY 1),
 d AS (SELECT user_id FROM s WHERE expires_at < TIMESTAMP '2024-01-31 12:00:00' OR created_at < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 29 DAY)"""


@query("retention_sweep", ctes("episodes_v", more=_SWEEP) + "SELECT id FROM episodes_v WHERE user_id NOT IN (SELECT user_id FROM d)")
def retention_sweep(t):
    """First sign-ups as sessions with a time to live; expired or old ones take their scope along."""
    e = episodes(t)
    created = e.filter("event_type = 'signup'").groupBy(*SCOPE, "user_id").agg(F.min("ts").alias("created_at"))
    life = F.make_dt_interval((F.col("user_id") % 30 + 5).cast("int"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(18,6)"))
    sessions = created.withColumn("expires_at", F.col("created_at") + life)
    _, _, kept = maintain.retention_sweep(sessions, {"episodes": e}, as_of=as_of(), max_age_days=29, keep_days=1)
    return kept["episodes"].select("id")
