"""Consolidation as set jobs over all scopes at once.

Model calls are user functions over bounded blocks of rows (``mapInPandas``); everything around
them is joins, aggregates and windows keyed by scope.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memspark.functions import text as X
from memspark.functions import timeex as D
from memspark.functions.vectors import embed_texts
from memspark.operators.graph import cluster_cap, topic_clusters
from memspark.operators.panels import interactions
from memspark.operators.running import positions, top_per_key
from memspark.operators.scope import SCOPE
from memspark.operators.versions import current_period_head, current_versions, summary_id, version_number
from memspark.session import materialize

# Batch sizes and levels.
GROUNDING_BATCH, RELATED_SUMMARIES = 20, 5
#: Summaries of an entity that are fetched one by one; more are matched in cells.
HUB_ROWS = 4096
#: Entities of a trigger whose subsets are looked up one by one.
FEW_ENTITIES = 3
SOURCES_PER_PART = 200
LEVEL_ABOVE = {"daily": "weekly", "weekly": "monthly", "monthly": "yearly"}
LEVEL_BELOW = {above: below for below, above in LEVEL_ABOVE.items()}


def ordered_text(column: str, order: str, sep: str) -> Column:
    """Texts of a bounded group joined in ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), sep)


def daily_sources(episodes: DataFrame, *, per_part: int = SOURCES_PER_PART) -> DataFrame:
    """Blocks of a day's interactions per scope in time order: scope, day, part_no, n_sources, text.

    A busy day is several parts of at most ``per_part`` sources, numbered in order, so no day has
    to fit into one row. ``episodes``: scope, id, ts, type, input_text, output_text.
    """
    rows = interactions(episodes).withColumn("day", F.to_date("ts"))
    rows = positions(rows, [*SCOPE, "day"], F.date_trunc("second", "ts"), [F.col("ts"), F.col("id")], "_pos")
    date = F.date_format("day", "yyyy-MM-dd")
    block = X.source_block(F.col("id"), date, X.episode_text(F.col("input_text"), F.col("output_text")))
    parts = rows.withColumn("part_no", F.floor((F.col("_pos") - 1) / per_part)).withColumn("_block", block)
    return parts.groupBy(*SCOPE, "day", "part_no").agg(F.count(F.lit(1)).alias("n_sources"), ordered_text("_block", "_pos", "").alias("text"))


OUTPUT = T.StructType([
    T.StructField("scope_kind", T.StringType()), T.StructField("scope_owner", T.StringType()), T.StructField("day", T.DateType()),
    T.StructField("cluster", T.StringType()), T.StructField("part_no", T.LongType()), T.StructField("summary", T.StringType()),
    T.StructField("key_facts", T.ArrayType(T.StructType([T.StructField("fact", T.StringType()), T.StructField("source_episode_ids", T.ArrayType(T.StringType()))]))),
    T.StructField("entities", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType()))]))),
    T.StructField("relationships", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("subject_kind", "subject_name", "predicate", "object_kind", "object_name", "valid_from", "valid_until")]))),
    T.StructField("error", T.StringType()),
])


def daily_digest(episodes: DataFrame, embed: Callable[[Column], Column], extract: Callable, *, dimensions: int, min_sources: int, per_part: int = SOURCES_PER_PART) -> DataFrame:
    """Extractor output for every cluster part of every day, failures told in ``error``.

    Days of at least ``min_sources`` sources are split into topic clusters by the similarity of their sources' vectors; every
    cluster goes to ``extract`` in parts of at most ``per_part`` sources. ``extract`` maps batches of
    (scope, day, cluster, part_no, source_ids, text) to ``OUTPUT`` rows.
    """
    src = interactions(episodes).select(*SCOPE, F.to_date("ts").alias("day"), "id", "ts", X.episode_text(F.col("input_text"), F.col("output_text")).alias("text"))
    ids = [*SCOPE, "day", "id"]
    vecs = embed_texts(src.select(*ids, "text"), ids, F.col("text"), embed, "vector").select(*ids, "vector")
    clusters = topic_clusters(vecs, min_sources=min_sources)
    clusters = cluster_cap(vecs, clusters, dimensions=dimensions)
    rows = src.join(clusters, [*SCOPE, "day", "id"])
    rows = positions(rows, [*SCOPE, "day", "cluster"], F.date_trunc("second", "ts"), [F.col("ts"), F.col("id")], "_pos")
    rows = rows.withColumn("part_no", F.floor((F.col("_pos") - 1) / per_part)).withColumn(
        "_block", X.source_block(F.col("id"), F.date_format("day", "yyyy-MM-dd"), F.col("text"))
    )
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_pos", "id"))), lambda r: r["id"])
    blocks = rows.groupBy(*SCOPE, "day", "cluster", "part_no").agg(ids.alias("source_ids"), ordered_text("_block", "_pos", "").alias("text"))
    return blocks.mapInPandas(extract, OUTPUT)


def merge_outputs(outputs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One output per key from its few cluster outputs: facts in order, non-blank prose by blank line."""
    prose = outputs.filter(X.strip(F.coalesce("summary", F.lit(""))) != "").groupBy(*keys).agg(ordered_text("summary", order, "\n\n").alias("summary"))
    facts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("key_facts").alias("f")))), lambda r: r["f"]))
    rest = outputs.groupBy(*keys).agg(facts.alias("key_facts"))
    return rest.join(prose, keys, "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def due_rollups(dates: DataFrame) -> DataFrame:
    """Rollups due on each date: date, level, source_level, period, source_periods.

    Mondays close the last ISO week, the first of a month its month, New Year its year.
    """
    d, last = F.col("date"), F.date_sub("date", 1)
    month = F.trunc(last, "month")
    week_days = F.transform(F.sequence(F.lit(7), F.lit(1)), lambda i: F.date_format(F.date_sub(d, i), "yyyy-MM-dd"))
    mondays = F.filter(F.sequence(month, last), lambda x: F.dayofweek(x) == 2)
    months = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.concat(F.year(last).cast("string"), F.lit("-"), F.lpad(m.cast("string"), 2, "0")))

    def job(level, when, period, sources):
        return F.when(when, F.struct(F.lit(level).alias("level"), F.lit(LEVEL_BELOW[level]).alias("source_level"), period.alias("period"), sources.alias("source_periods")))

    jobs = F.array(
        job("weekly", F.dayofweek(d) == 2, D.period_key(last, "weekly"), week_days),
        job("monthly", F.dayofmonth(d) == 1, D.period_key(last, "monthly"), F.transform(mondays, lambda x: D.period_key(x, "weekly"))),
        job("yearly", F.dayofyear(d) == 1, D.period_key(last, "yearly"), months),
    )
    return dates.select("date", F.explode(F.array_compact(jobs)).alias("j")).select("date", "j.*")


def rollup_stale(rollups: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether any current source of a rollup is newer than the rollup.

    ``rollups``: scope, level, period, created_at, source_summary_periods. ``sources``: current
    summaries one level below. Every current source counts, corrected ones included: a correction
    is just what makes a rollup stale.
    """
    parts = rollups.select(*SCOPE, "level", "period", F.col("created_at").alias("_made"), F.explode("source_summary_periods").alias("_source"))
    newest = sources.groupBy(*SCOPE, F.col("period").alias("_source")).agg(F.max("created_at").alias("_new"))
    return parts.join(newest, [*SCOPE, "_source"], "left").groupBy(*SCOPE, "level", "period").agg(
        F.coalesce(F.max("_new") > F.max("_made"), F.lit(False)).alias("stale")
    )


def run_rollup(summaries: DataFrame, jobs: DataFrame) -> DataFrame:
    """Rollups to write: scope, level, period, id, supersedes, n_sources, source_ids, text.

    ``summaries``: scope, id, level, period, created_at, supersedes, summary. A scope without
    sources gets none; an existing rollup is written again only when a source is newer. A period
    lists at most twelve source periods, each with its current summaries.
    """
    current = current_versions(summaries)
    wanted = jobs.select("level", "source_level", "period", F.explode("source_periods").alias("_source")).distinct()
    src = current.select(*SCOPE, F.col("level").alias("source_level"), F.col("period").alias("_source"), "id", "summary", "created_at")
    hits = src.join(wanted, ["source_level", "_source"])
    block = X.source_block(F.col("id"), F.lit(""), F.col("summary"))
    row = F.struct("_source", "id", block.alias("block"))
    grouped = hits.groupBy(*SCOPE, "level", "period").agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.max("created_at").alias("_newest"))
    heads = current_period_head(summaries).select(*SCOPE, "level", "period", F.col("id").alias("supersedes"), F.col("created_at").alias("_made"))
    due = grouped.join(heads, [*SCOPE, "level", "period"], "left").filter(F.col("_made").isNull() | (F.col("_newest") > F.col("_made")))
    last = summaries.groupBy(*SCOPE, "level", "period").agg(F.max(version_number(F.col("id"))).alias("_v"))
    due = due.join(last, [*SCOPE, "level", "period"], "left")
    ident = summary_id(F.col("scope_owner"), F.col("period"), F.col("level"), F.coalesce("_v", F.lit(0)) + 1)
    return due.select(
        *SCOPE, "level", "period", ident.alias("id"), "supersedes", F.size("_rows").alias("n_sources"),
        F.transform("_rows", lambda r: r["id"]).alias("source_ids"), F.array_join(F.transform("_rows", lambda r: r["block"]), "").alias("text"),
    )


def refresh_cascade(changed: DataFrame, rollups: DataFrame) -> DataFrame:
    """Rollups to refresh after ``changed`` (scope, level, period), level by level upward.

    ``rollups``: scope, level, period, source_summary_periods. Three rounds reach the year.
    """
    covers = rollups.select(*SCOPE, "level", "period", F.explode("source_summary_periods").alias("_source")).distinct()
    covers = materialize(covers, "covers")
    given = changed.select(*SCOPE, "level", "period")
    found: list[DataFrame] = []
    for below, above in LEVEL_ABOVE.items():
        front = given.filter(F.col("level") == below)
        if found:  # the level just found lies right below
            front = front.unionByName(found[-1])
        hit = front.select(*SCOPE, F.col("period").alias("_source"))
        up = covers.filter(F.col("level") == above).join(hit, [*SCOPE, "_source"], "left_semi").select(*SCOPE, "level", "period").distinct()
        found.append(up)
    return reduce(DataFrame.unionByName, found)


def citation_validate(facts: DataFrame) -> DataFrame:
    """Cited episodes kept only where they are sources of the daily summary; other levels cite none.

    ``facts``: level, cites, source_episode_ids. Repeats stay.
    """
    real = F.filter("cites", lambda c: F.array_contains(F.col("source_episode_ids"), c))
    none = F.array().cast("array<string>")
    return facts.withColumn("cites", F.when(F.col("level") == "daily", F.coalesce(real, none)).otherwise(none))


VERDICTS = "struct<grounded:array<struct<i:int,ok:boolean>>>"


def grounding_resolve(facts: DataFrame, verdicts: DataFrame, keys: list[str], *, batch: int = GROUNDING_BATCH) -> DataFrame:
    """Grounded flag of every fact from the judge's answers.

    ``facts``: keys, fact_no (from 1), is_inference. ``verdicts``: keys, batch_no, answer (text with
    a JSON object). The first verdict per number wins, a missing one means ungrounded; inferences
    are kept without a check.
    """
    answer = F.from_json(X.first_json_object(F.col("answer")), VERDICTS)
    said = verdicts.select(*keys, "batch_no", F.posexplode(answer["grounded"]).alias("_ord", "_v"))
    said = said.groupBy(*keys, "batch_no", F.col("_v.i").alias("_i")).agg(F.min_by("_v.ok", "_ord").alias("_ok"))
    literal = facts.filter(~F.col("is_inference"))
    numbered = literal.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy("fact_no")))
    numbered = numbered.withColumn("batch_no", F.floor((F.col("_n") - 1) / batch)).withColumn("_i", ((F.col("_n") - 1) % batch + 1).cast("int"))
    checked = numbered.join(said, [*keys, "batch_no", "_i"], "left").select(*facts.columns, F.coalesce("_ok", F.lit(False)).alias("grounded"))
    return checked.unionByName(facts.filter("is_inference").withColumn("grounded", F.lit(True)))


def attribution_resolve(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Used flag of each citation: keys, pos, used. Unknown when the judge's list has another length.

    ``answers``: keys, citations (array), answer (JSON with ``used``).
    """
    used = F.from_json(X.first_json_object(F.col("answer")), "struct<used:array<boolean>>")["used"]
    fits = F.size(used) == F.size("citations")
    flags = F.when(fits, used).otherwise(F.transform("citations", lambda c: F.lit(None).cast("boolean")))
    return answers.select(*keys, F.posexplode(F.arrays_zip(F.col("citations").alias("citation"), flags.alias("used"))).alias("pos", "_z")).select(
        *keys, "pos", "_z.citation", "_z.used"
    )


def store_summary(outputs: DataFrame, summaries: DataFrame, *, created_at: Column) -> dict[str, DataFrame]:
    """Rows to append for new summary versions: ``summaries``, ``facts`` and mirrored ``memories``.

    ``outputs``: scope, level, period, summary, source_episode_ids, entities_touched, supersedes,
    correction_reason, key_facts (array of fact, cites, grounded, expires_at, expire_reason,
    source_count, is_inference). One output per (scope, level, period).
    """
    last = summaries.groupBy(*SCOPE, "level", "period").agg(F.max(version_number(F.col("id"))).alias("_v"))
    rows = outputs.join(last, [*SCOPE, "level", "period"], "left").withColumn(
        "id", summary_id(F.col("scope_owner"), F.col("period"), F.col("level"), F.coalesce("_v", F.lit(0)) + 1)
    ).withColumn("created_at", created_at)
    head = [*SCOPE, "id", "level", "period", "summary", "source_episode_ids", "entities_touched", "supersedes", "correction_reason", "created_at"]
    facts = rows.select(*SCOPE, F.col("id").alias("summary_id"), "level", "source_episode_ids", F.posexplode("key_facts").alias("fact_no", "f"))
    facts = facts.select(*SCOPE, "summary_id", "level", "source_episode_ids", "fact_no", "f.fact", "f.cites", "f.grounded", "f.expires_at", "f.expire_reason", "f.source_count", "f.is_inference")
    expires = X.optional_date(F.col("expires_at"))
    facts = citation_validate(facts).withColumn("expires_at", expires).withColumn(
        "expire_reason", F.when(expires.isNotNull() & (F.col("expire_reason") != ""), F.col("expire_reason"))
    ).withColumn("source_count", F.greatest(F.coalesce("source_count", F.lit(1)), F.lit(1)))
    # a fact's id follows from its place, so a repeated run writes the same rows
    facts = facts.withColumn("id", F.sha2(F.concat_ws("|", *SCOPE, "summary_id", F.col("fact_no").cast("string")), 256)).drop("level", "source_episode_ids")
    memories = facts.select(
        X.fact_memory_id(F.col("id")).alias("id"), *SCOPE, "summary_id", F.col("fact").alias("content"), F.lit(False).alias("is_static"),
        "grounded", "cites", "expires_at", "source_count", "is_inference",
    )
    return {"summaries": rows.select(*head), "facts": facts, "memories": memories}


def correct_summary(corrections: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted new versions, rejects) for corrections (scope, summary_id, summary, reason).

    A correction needs a reason and a target that exists and is not superseded yet.
    """
    target = summaries.select(*SCOPE, F.col("id").alias("summary_id"), "level", "period", F.lit(True).alias("_known"))
    newer = summaries.filter("supersedes is not null").groupBy(*SCOPE, F.col("supersedes").alias("summary_id")).agg(F.max("id").alias("_by"))
    checked = corrections.join(target, [*SCOPE, "summary_id"], "left").join(newer, [*SCOPE, "summary_id"], "left")
    problem = (
        F.when(F.coalesce("reason", F.lit("")) == "", "reason required").when(F.col("_known").isNull(), "no such summary")
        .when(F.col("_by").isNotNull(), F.concat(F.lit("already superseded by "), "_by"))
    )
    checked = checked.withColumn("problem", problem)
    last = summaries.groupBy(*SCOPE, "level", "period").agg(F.max(version_number(F.col("id"))).alias("_v"))
    good = checked.filter("problem is null").join(last, [*SCOPE, "level", "period"], "left")
    accepted = good.select(
        *SCOPE, summary_id(F.col("scope_owner"), F.col("period"), F.col("level"), F.col("_v") + 1).alias("id"), "level", "period", "summary",
        F.col("summary_id").alias("supersedes"), F.col("reason").alias("correction_reason"),
    )
    return accepted, checked.filter("problem is not null").select(*SCOPE, "summary_id", "problem")


def contradiction_apply(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Facts after a judge's verdicts: scope, summary_id, id, fact, source_count, outcome.

    ``facts``: scope, summary_id, id, fact, source_count. ``verdicts``: scope, summary_id, ord,
    old_fact, replacement, reason. A verdict names its fact by exact text. Restatements
    (``redundant``) count as one more source, an empty replacement removes the fact. Of several
    facts with one text each replacing or removing verdict takes the next one.
    """
    key = [*SCOPE, "summary_id", "fact"]
    dup = facts.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("id")))
    v = verdicts.select(*SCOPE, "summary_id", F.col("old_fact").alias("fact"), "ord", "replacement", (F.col("reason") == "redundant").alias("_again"))
    before = W.partitionBy(*key).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    v = v.withColumn("_n", 1 + F.coalesce(F.sum(F.when(F.col("_again"), 0).otherwise(1)).over(before), F.lit(0)))
    act = v.groupBy(*key, "_n").agg(F.count(F.when(F.col("_again"), 1)).alias("_more"), F.max(F.when(~F.col("_again"), F.coalesce("replacement", F.lit("")))).alias("_new"))
    rows = dup.join(act, [*key, "_n"], "left")
    outcome = (
        F.when(F.col("_new") == "", "removed").when(F.col("_new").isNotNull(), "replaced").when(F.col("_more") > 0, "reinforced").otherwise("kept")
    )
    more = F.coalesce("_more", F.lit(0))
    count = F.when(more > 0, F.greatest(F.col("source_count"), F.lit(1)) + more).otherwise(F.col("source_count"))
    return rows.select(*SCOPE, "summary_id", "id", F.col("fact").alias("old_fact"), F.when(F.col("_new") != "", F.col("_new")).otherwise(F.col("fact")).alias("fact"), count.cast("int").alias("source_count"), outcome.alias("outcome"))


def relation_record(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Relations between facts named by exact text: scope, from_memory_id, to_memory_id, relation_type.

    ``pairs``: scope, from_summary, from_fact, to_summary, to_fact, relation_type. A text that names
    no fact is skipped rather than guessed.
    """
    ids = facts.groupBy(*SCOPE, "summary_id", "fact").agg(F.max("id").alias("_id"))

    def side(name):
        return ids.select(*SCOPE, F.col("summary_id").alias(f"{name}_summary"), F.col("fact").alias(f"{name}_fact"), X.fact_memory_id(F.col("_id")).alias(f"{name}_memory_id"))

    hit = pairs.join(side("from"), [*SCOPE, "from_summary", "from_fact"]).join(side("to"), [*SCOPE, "to_summary", "to_fact"])
    return hit.select(*SCOPE, "from_memory_id", "to_memory_id", "relation_type")


def derives_record(inferences: DataFrame, heads: DataFrame) -> DataFrame:
    """Relations from inferred facts to the attributes they follow from.

    ``inferences``: scope, fact_id, entity_id, attribute_keys; ``heads``: current attribute rows.
    """
    wanted = inferences.select(*SCOPE, "fact_id", "entity_id", F.explode("attribute_keys").alias("attribute_key"))
    hit = wanted.join(heads.select(*SCOPE, "entity_id", "attribute_key", F.col("id").alias("to_memory_id")), [*SCOPE, "entity_id", "attribute_key"])
    return hit.select(*SCOPE, X.fact_memory_id(F.col("fact_id")).alias("from_memory_id"), "to_memory_id", F.lit("derives").alias("relation_type"))


def _subsets(items: Column, most: int) -> Column:
    """Subsets of an array of 1 to ``most`` items, each in the array's order."""
    grown = F.aggregate(items, F.array(F.slice(items, 1, 0)), lambda have, x: F.concat(have, F.transform(F.filter(have, lambda s: F.size(s) < most), lambda s: F.concat(s, F.array(x)))))
    return F.filter(grown, lambda s: F.size(s) > 0)


def best_of_sets(docs: DataFrame, stats: DataFrame, asked: DataFrame, top: int, few: int) -> DataFrame:
    """The ``top`` best of ``docs`` for each of ``asked`` (scope, query_id, terms), itself left out: scope, query_id, doc_id, created_at, score, rank.

    ``docs``: scope, doc_id, created_at, held (term, times), plain. What a document shares with up to ``few`` terms is a
    subset of them, and in the list of that subset (for documents with repeats: of subset and times) only documents that do no
    worse stand before it. So the first of each list are all that can matter, however many documents a term has.
    """
    at = F.col("created_at").cast("timestamp")
    # in lists newest first (without a time last), then by id
    row = F.struct(at.isNull().alias("n"), (-F.unix_micros(at)).alias("t"), "doc_id", "created_at")
    wanted = asked.select(*SCOPE, "query_id", F.explode(_subsets(F.col("terms"), few)).alias("subset"))

    def lists(rows: DataFrame, keys: list[str]) -> DataFrame:
        each = rows.select(*SCOPE, row.alias("r"), F.explode(_subsets(F.col("held"), few)).alias("_s"))
        each = each.select(*SCOPE, F.transform("_s", lambda h: h["term"]).alias("subset"), F.transform("_s", lambda h: h["times"]).alias("times"), "r")
        # one more, as one of them may be the one that asks; what they were ordered by stays behind
        first = top_per_key(each, [*SCOPE, *keys], [F.col("r")], top + 1)
        return first.groupBy(*SCOPE, *keys).agg(F.collect_list(F.struct("r.doc_id", "r.created_at")).alias("list"))

    freq = stats.select(*SCOPE, F.array("term").alias("subset"), "_freq")
    met = wanted.join(lists(docs.filter("plain"), ["subset"]).join(freq, [*SCOPE, "subset"], "full"), [*SCOPE, "subset"]).withColumn("times", F.lit(None).cast("array<bigint>"))
    repeats = docs.filter("NOT plain")
    if not repeats.isEmpty():
        met = met.unionByName(wanted.join(lists(repeats, ["subset", "times"]), [*SCOPE, "subset"]), allowMissingColumns=True)
    single = F.when(F.col("_freq").isNotNull(), F.struct(F.col("subset")[0], "_freq"))
    met = met.groupBy(*SCOPE, "query_id").agg(F.map_from_entries(F.collect_list(single)).alias("_f"), F.collect_list(F.when(F.col("list").isNotNull(), F.struct("subset", "times", "list"))).alias("_l"))

    weights = F.transform("subset", lambda t, i: F.coalesce(F.get("times", i), F.lit(1)) / F.element_at("_f", t))
    score = F.round(F.aggregate(weights, F.lit(0.0), lambda n, w: n + w), 9)
    found = met.select(*SCOPE, "query_id", "_f", F.inline("_l")).select(*SCOPE, "query_id", score.alias("score"), F.inline("list")).filter(F.col("doc_id") != F.col("query_id"))
    # a document in several lists counts by its best, that of all it shares
    found = found.groupBy(*SCOPE, "query_id", "doc_id", "created_at").agg(F.max("score").alias("score"))
    return top_per_key(found, [*SCOPE, "query_id"], [F.col("score").desc(), F.col("created_at").desc(), F.col("doc_id")], top, "rank")


def entity_specificity(summaries: DataFrame, triggers: DataFrame, *, top: int = RELATED_SUMMARIES, hub_rows: int = HUB_ROWS, few: int = FEW_ENTITIES) -> DataFrame:
    """Current summaries related to each trigger by shared entities, rare entities weighing more.

    ``summaries``: scope, id, entities_touched, created_at, supersedes. ``triggers``: scope, id,
    entities_touched. Triggers of up to ``few`` entities meet the lists of the sets of entities (``best_of_sets``). For the others, an entity that more than ``top`` summaries touch assures that many results of its weight.
    Entities whose weights together stay below the best such assurance cannot bring in a summary on their own: only
    the rarer ones fetch candidates, and hubs just add to the scores. Triggers that need an entity of over
    ``hub_rows`` summaries all the same are matched cell by cell.
    """
    current = current_versions(summaries)
    docs = current.groupBy(*SCOPE, F.col("id").alias("doc_id"), "created_at").agg(F.flatten(F.collect_list("entities_touched")).alias("_e"))
    held = F.filter(F.array_sort(F.array_distinct("_e")), lambda x: x.isNotNull())
    held = F.transform(held, lambda x: F.struct(x.alias("term"), F.size(F.filter("_e", lambda y: y == x)).cast("long").alias("times")))
    docs = docs.select(*SCOPE, "doc_id", "created_at", held.alias("held"))
    docs = materialize(docs.withColumn("plain", ~F.exists("held", lambda h: h["times"] > 1)), "touched")
    stats = docs.select(*SCOPE, F.inline("held")).groupBy(*SCOPE, "term").agg(F.sum("times").alias("_freq"), F.count(F.lit(1)).alias("docs"), F.max("times").alias("_most"))
    terms = F.filter(F.array_sort(F.array_distinct(F.flatten(F.collect_list("entities_touched")))), lambda x: x.isNotNull())
    asked = materialize(triggers.groupBy(*SCOPE, F.col("id").alias("query_id")).agg(terms.alias("terms")), "asked")
    ranked = best_of_sets(docs, stats, asked.filter(F.size("terms") <= few), top, few)
    large = asked.filter(F.size("terms") > few)
    return ranked if large.isEmpty() else ranked.unionByName(_specific_to_many(docs, stats, large, top, hub_rows))


def _specific_to_many(docs: DataFrame, stats: DataFrame, asked: DataFrame, top: int, hub_rows: int) -> DataFrame:
    """``entity_specificity`` of triggers (scope, query_id, terms) with many entities."""
    from memspark.operators import kernels
    from memspark.operators.cells import cut_into_cells, match_cells

    asked = asked.select(*SCOPE, "query_id", F.explode("terms").alias("term"))
    row = F.struct((1 / F.col("_freq")).alias("weight"), "term", "docs", (F.col("_most") / F.col("_freq")).alias("most"))
    of_query = asked.join(stats, [*SCOPE, "term"]).groupBy(*SCOPE, "query_id").agg(F.sort_array(F.collect_list(row), asc=False).alias("_t"))
    sure = F.coalesce(F.array_max(F.transform(F.filter("_t", lambda x: x["docs"] > top), lambda x: x["weight"])), F.lit(0.0))
    # with each entity, what it and all more common ones can add up to
    left = F.transform("_t", lambda x, i: F.aggregate(F.slice("_t", i + 1, F.size("_t")), F.lit(0.0), lambda n, y: n + y["most"]))
    needed = F.transform(F.filter(F.arrays_zip(F.col("_t").alias("t"), left.alias("left")), lambda z: z["left"] >= F.col("_sure") - 2e-9), lambda z: z["t"])
    plan = of_query.withColumn("_sure", sure).withColumn("_need", needed)
    plan = materialize(plan.select(*SCOPE, "query_id", F.transform("_t", lambda x: x["term"]).alias("terms"), F.transform("_need", lambda x: x["term"]).alias("need"), F.exists("_need", lambda x: x["docs"] > hub_rows).alias("wide")), "plan")

    posts = docs.select(*SCOPE, "doc_id", "created_at", F.inline("held")).join(stats.select(*SCOPE, "term", "_freq"), [*SCOPE, "term"])
    posts = materialize(posts.select(*SCOPE, "doc_id", "created_at", "term", (F.col("times") / F.col("_freq")).alias("weight")), "posts")
    docs = posts.groupBy(*SCOPE, "doc_id", "created_at").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("held"))
    by_term = docs.withColumn("term", F.explode(F.transform("held", lambda h: h["term"])))
    fetch = plan.filter("NOT wide").select(*SCOPE, "query_id", "terms", "need", F.explode("need").alias("term"))
    pairs = fetch.join(by_term, [*SCOPE, "term"]).filter("query_id != doc_id")
    # a summary fetched by several entities counts by the first
    pairs = pairs.filter(F.col("term") == F.filter("need", lambda t: F.exists("held", lambda h: h["term"] == t))[0])
    score = F.aggregate(F.filter("held", lambda h: F.array_contains("terms", h["term"])), F.lit(0.0), lambda n, h: n + h["weight"])
    found = pairs.select(*SCOPE, "query_id", "doc_id", "created_at", F.round(score, 9).alias("score"))

    wide = plan.filter("wide").select(*SCOPE, "query_id", F.explode("terms").alias("term"))
    posted = posts.join(wide.select(*SCOPE, "term").distinct(), [*SCOPE, "term"], "left_semi")
    cells = cut_into_cells(posted, wide, SCOPE, ["doc_id"], ["query_id"], 1 << 18, 1 << 14)
    found = found.unionByName(match_cells(*cells, kernels.specific_best(SCOPE, top), "scope_kind string, scope_owner string, query_id string, doc_id string, created_at timestamp_ntz, score double"))
    order = [F.col("score").desc(), F.col("created_at").desc(), F.col("doc_id")]
    return top_per_key(found, [*SCOPE, "query_id"], order, top, "rank")


def current_content(summaries: DataFrame, facts: DataFrame, entities: DataFrame, attributes: DataFrame) -> DataFrame:
    """The editable document of every current summary as JSON: scope, id, document.

    Facts and touched entities of one summary are few and travel as arrays.
    """
    cur = current_versions(summaries).select(*SCOPE, "id", "summary", "entities_touched")
    fact = F.struct(F.col("id").alias("i"), F.struct("fact", "source_count").alias("v"))
    f = facts.groupBy(*SCOPE, F.col("summary_id").alias("id")).agg(F.array_sort(F.collect_list(fact)).alias("_f"))
    ents = entities.select(*SCOPE, F.col("id").alias("entity_id"), "kind", "name").join(attributes.select(*SCOPE, "entity_id", "attributes"), [*SCOPE, "entity_id"], "left")
    touched = cur.select(*SCOPE, "id", F.posexplode("entities_touched").alias("_pos", "entity_id")).join(ents, [*SCOPE, "entity_id"])
    ent = F.struct(F.col("_pos").alias("i"), F.struct(F.col("entity_id").alias("id"), "kind", "name", "attributes").alias("v"))
    e = touched.groupBy(*SCOPE, "id").agg(F.array_sort(F.collect_list(F.struct(F.col("_pos").alias("i"), F.to_json(ent["v"]).alias("v")))).alias("_e"))
    rows = cur.join(f, [*SCOPE, "id"], "left").join(e, [*SCOPE, "id"], "left")
    facts_json = F.coalesce(F.to_json(F.transform("_f", lambda r: r["v"])), F.lit("[]"))
    ents_json = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("_e", lambda r: r["v"]), ","), F.lit("")), F.lit("]"))
    doc = F.concat(F.lit('{"summary":'), F.to_json(F.struct("summary")), F.lit(',"key_facts":'), facts_json, F.lit(',"entities_touched":'), ents_json, F.lit("}"))
    return rows.select(*SCOPE, "id", doc.alias("document"))
