"""The portable bundle: JSON records of a corpus, and merging them into existing tables.

Two layouts are read: the exchange tree with one folder per scope (``manifest.json``,
``scopes/<dir>/episodes/YYYY/MM/YYYY-MM-DD.jsonl``, ``summaries/<level>/<period>.json``,
``entities.jsonl``, ``memory_relations.jsonl``), and what ``write_bundle`` writes, where the scope
stands in every record and folders go by month only, so millions of scopes do not become millions
of small files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.operators.joins import locator_resolve
from memspark.operators.scope import SCOPE
from memspark.operators.versions import summary_id, version_chain_order
from memspark.schemas import BUNDLE_DDL, MANIFEST_DDL, SCOPE_DDL, struct


# Times keep their microseconds.
TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Records repeat their field names and scopes: packed they take a tenth. Spark reads both kinds.
LINES = {"compression": "gzip"}


def _with_scope(df: DataFrame, manifest: DataFrame) -> DataFrame:
    """Scope of a record from the folder its file lies in."""
    folder = F.regexp_extract("_file", r"(scopes/[^/]+)/", 1)
    dirs = manifest.select(F.explode("scopes").alias("s")).select(F.col("s.dir").alias("_dir"), "s.scope_kind", "s.scope_owner")
    return df.withColumn("_dir", folder).join(dirs, "_dir", "inner").drop("_dir", "_file")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(struct(MANIFEST_DDL)).json(f"{root}/manifest.json", multiLine=True)


def _read(spark: SparkSession, root: str, name: str, glob: str, many_lines: bool = False) -> DataFrame:
    reader = spark.read.schema(struct(BUNDLE_DDL[name])).option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    sub = {"episodes": "/scopes", "summaries": "/scopes", "entities": "/scopes", "memory_relations": "/scopes"}[name]
    return reader.json(root + sub, multiLine=many_lines).withColumn("_file", F.col("_metadata.file_path"))


def read_tree_episodes(spark: SparkSession, root: str) -> DataFrame:
    return _with_scope(_read(spark, root, "episodes", "????-??-??.jsonl"), read_manifest(spark, root))


def read_tree_summaries(spark: SparkSession, root: str) -> DataFrame:
    return _with_scope(_read(spark, root, "summaries", "*.json", True), read_manifest(spark, root))


def read_tree_entities(spark: SparkSession, root: str) -> DataFrame:
    return _with_scope(_read(spark, root, "entities", "entities.jsonl"), read_manifest(spark, root))


def read_tree_relations(spark: SparkSession, root: str) -> DataFrame:
    return _with_scope(_read(spark, root, "memory_relations", "memory_relations.jsonl"), read_manifest(spark, root))


def read_bundle(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One dataset written by ``write_bundle``."""
    extra = {"episodes": ", year int, month int", "summaries": ""}.get(name, "")
    rows = spark.read.schema(struct(f"{SCOPE_DDL}, {BUNDLE_DDL[name]}{extra}")).json(f"{root}/{name}")
    return rows.drop("year", "month")


def summary_facts(summaries: DataFrame) -> DataFrame:
    """Facts nested in summary records, one row each."""
    rows = summaries.select(*SCOPE, F.col("id").alias("summary_id"), F.posexplode("key_facts").alias("fact_no", "f"))
    return rows.select(*SCOPE, "summary_id", "fact_no", "f.*").withColumn("source_count", F.greatest(F.coalesce("source_count", F.lit(1)), F.lit(1)))


def bundle_manifest(episodes: DataFrame, summaries: DataFrame | None = None, entities: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """Counts and time span per scope."""
    out = episodes.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("episode_count"), F.min("ts").alias("earliest_episode_at"), F.max("ts").alias("latest_episode_at"))
    for name, df in (("summary_count", summaries), ("entity_count", entities), ("memory_relation_count", relations)):
        if df is not None:
            out = out.join(df.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias(name)), SCOPE, "full_outer")
    counts = [c for c in out.columns if c.endswith("_count")]
    return out.select(*SCOPE, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], "earliest_episode_at", "latest_episode_at")


def _record(df: DataFrame, name: str) -> DataFrame:
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in struct(BUNDLE_DDL[name])]
    return df.select(*SCOPE, *cols)


def write_bundle(root: str, *, episodes: DataFrame, summaries: DataFrame, entities: DataFrame, relations: DataFrame | None = None) -> None:
    """All datasets as JSON lines, ordered by time, by level and period, by id; and the manifest.

    Range partitions follow (scope, order), so a big scope spreads over many files in order.
    """
    e = _record(episodes, "episodes").withColumn("year", F.year("ts")).withColumn("month", F.month("ts"))
    e.repartitionByRange("year", "month", *SCOPE, "ts", "id").sortWithinPartitions("year", "month", *SCOPE, "ts", "id").write.partitionBy("year", "month").json(f"{root}/episodes", **TIME, **LINES)
    s = _record(summaries, "summaries")
    order = [*SCOPE, "level", "period", "created_at", "id"]
    s.repartitionByRange(*order).sortWithinPartitions(*order).write.json(f"{root}/summaries", **TIME, **LINES)
    n = _record(entities, "entities")
    n.repartitionByRange(*SCOPE, "id").sortWithinPartitions(*SCOPE, "id").write.json(f"{root}/entities", **TIME, **LINES)
    if relations is not None:
        _record(relations, "memory_relations").write.json(f"{root}/memory_relations", **LINES)
    bundle_manifest(episodes, summaries, entities, relations).write.json(f"{root}/manifest", **TIME, **LINES)


def import_merge_episodes(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, imported/skipped counts per scope).

    A row is skipped when its content hash is in the scope already or came earlier in the input. A
    taken id gets a new one derived from the row, and ``refers_to`` follows the renamed rows.
    Copies of one text may be a third of the input: the first copy is found by a combined minimum.
    """
    first = incoming.groupBy(*SCOPE, "hash").agg(F.min(F.struct("ts", "id")).alias("_first"))
    first = first.select(*SCOPE, "hash", F.col("_first.ts").alias("ts"), F.col("_first.id").alias("id"))
    fresh_keys = first.join(existing.select(*SCOPE, "hash").distinct(), [*SCOPE, "hash"], "left_anti")
    fresh = incoming.join(fresh_keys, [*SCOPE, "hash", "ts", "id"], "left_semi").dropDuplicates([*SCOPE, "hash", "ts", "id"])
    taken = existing.select("id").distinct().withColumn("_taken", F.lit(True))
    new_id = X.episode_id(F.col("ts"), F.col("scope_kind"), F.col("scope_owner"), F.col("hash"))
    named = fresh.join(taken, "id", "left").withColumn("_new", F.when(F.col("_taken"), new_id).otherwise(F.col("id")))
    renamed = named.filter(F.col("_taken")).select(*SCOPE, F.col("id").alias("refers_to"), F.col("_new").alias("_moved"))
    out = named.join(renamed, [*SCOPE, "refers_to"], "left").withColumn("refers_to", F.coalesce("_moved", "refers_to"))
    rows = out.withColumn("id", F.col("_new")).select(*incoming.columns)
    total = incoming.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("_all"))
    kept = fresh_keys.groupBy(*SCOPE).agg(F.count(F.lit(1)).alias("_in"))
    imported = F.coalesce("_in", F.lit(0).cast("long"))
    stats = total.join(kept, SCOPE, "left").select(*SCOPE, imported.alias("imported"), (F.col("_all") - imported).alias("skipped"))
    return rows, stats


def import_merge_summaries(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add with ``exported_id``, id map). Existing (scope, level, period)s are left alone.

    Versions are numbered anew so that each follows its predecessor; a link to a version that is not
    in the bundle is dropped.
    """
    period = [*SCOPE, "level", "period"]
    fresh = incoming.join(existing.select(*period).distinct(), period, "left_anti")
    deep = version_chain_order(fresh, period)
    order = W.partitionBy(*period).orderBy("depth", "created_at", "id")
    numbered = deep.withColumn("_v", F.row_number().over(order))
    numbered = numbered.withColumn("_new", summary_id(F.col("scope_owner"), F.col("period"), F.col("level"), F.col("_v")))
    ids = numbered.select(*SCOPE, F.col("id").alias("exported_id"), F.col("_new").alias("summary_id"))
    link = ids.select(*SCOPE, F.col("exported_id").alias("supersedes"), F.col("summary_id").alias("_link"))
    out = numbered.join(link, [*SCOPE, "supersedes"], "left")
    rows = out.withColumn("exported_id", F.col("id")).withColumn("dangling", F.col("supersedes").isNotNull() & F.col("_link").isNull()).withColumn(
        "id", F.col("_new")).withColumn("supersedes", F.col("_link"))
    return rows.select(*incoming.columns, "exported_id", "dangling"), ids


def import_merge_entities(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities to add, their attributes as static memory rows). Known ids are skipped, the first
    record of an id counts."""
    fresh = incoming.dropDuplicates([*SCOPE, "id"]).join(existing.select(*SCOPE, "id"), [*SCOPE, "id"], "left_anti")
    attrs = fresh.select(*SCOPE, F.col("id").alias("entity_id"), F.explode("attributes").alias("attribute_key", "content"))
    ident = X.attribute_memory_id(F.col("scope_kind"), F.col("scope_owner"), F.col("entity_id"), F.col("attribute_key"))
    rows = attrs.select(ident.alias("id"), *SCOPE, "entity_id", "attribute_key", "content", F.lit(True).alias("is_static"), F.lit(True).alias("grounded"))
    return fresh, rows


def import_merge_relations(existing: DataFrame, incoming: DataFrame, *, summary_ids: DataFrame, facts: DataFrame, heads: DataFrame) -> DataFrame:
    """Relations to add: both ends resolved in the target scope, not present yet.

    ``incoming``: scope, relation_type, from, to (locators).
    """

    def resolved(rows: DataFrame, side: str, kept: list[str]) -> DataFrame:
        # the rest of a relation travels with its locator: nothing has to meet it again afterwards
        loc = rows.select(*SCOPE, F.struct(*kept).alias("locator_id"), f"{side}.entity_id", f"{side}.attribute_key", F.col(f"{side}.summary_id").alias("summary_ref"), f"{side}.fact")
        ids = locator_resolve(loc, summary_ids, facts, heads).filter("memory_id is not null")
        return ids.select(*SCOPE, "locator_id.*", F.col("memory_id").alias(f"{side}_memory_id"))

    key = [*SCOPE, "from_memory_id", "to_memory_id", "relation_type"]
    both = resolved(resolved(incoming, "from", ["relation_type", "to"]), "to", ["relation_type", "from_memory_id"])
    return both.select(*key).distinct().join(existing.select(*key), key, "left_anti")


def memory_export(entities: DataFrame, summaries: DataFrame, facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """A scope's readable export as ordered JSON lines: scope, section, sort_key, line.

    Sections follow each other (entities, summaries with their facts, relationships); reading a
    scope's lines in order gives its document, without a document having to fit into one row.
    ``summaries`` are current ones.
    """
    e = entities.select(*SCOPE, F.lit(1).alias("section"), F.col("id").alias("sort_key"), F.to_json(F.struct("id", "kind", "name")).alias("line"))
    row = F.struct(F.col("id").alias("i"), F.struct("fact", "grounded", "source_count").alias("v"))
    packed = facts.groupBy(*SCOPE, F.col("summary_id").alias("id")).agg(F.array_sort(F.collect_list(row)).alias("_f"))
    s = summaries.join(packed, [*SCOPE, "id"], "left")
    body = F.struct("id", "period", "level", F.transform("_f", lambda r: r["v"]).alias("key_facts"))
    s = s.select(*SCOPE, F.lit(2).alias("section"), F.concat("period", F.lit("|"), "id").alias("sort_key"), F.to_json(body).alias("line"))
    r = relationships.select(*SCOPE, F.lit(3).alias("section"), F.col("id").alias("sort_key"), F.to_json(F.struct("id", "subject_id", "predicate", "object_id", "valid_from", "valid_until")).alias("line"))
    return e.unionByName(s).unionByName(r)


def write_memory_export(lines: DataFrame, path: str) -> None:
    order = [*SCOPE, "section", "sort_key"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).write.json(path, **LINES)
