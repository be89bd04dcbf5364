"""Hybrid retrieval for whole batches of queries over all scopes.

The steps of one search (gate, three summary channels, fusion, diversity, facts, exchanges,
entities, graph, text) are joins keyed by scope and query. Each search channel leaves at most a few
rows per query; those small results are written once to the shared folder and reused.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.functions import timeex as D
from memspark.functions import vectors as V
from memspark.operators import fusion, search
from memspark.operators.bm25 import bm25_topk
from memspark.operators.counting import countable_facts, exhaustive_count_facts
from memspark.operators.graph import graph_walk
from memspark.operators.joins import relations_of, self_model_anchor
from memspark.operators.matching import stage1_entity_match
from memspark.operators.panels import interactions, unexpired
from memspark.operators.running import top_per_key
from memspark.operators.scope import SCOPE
from memspark.operators.versions import current_attributes, current_versions
from memspark.session import materialize

# Sizes of the assembled text.
CONTEXT_BUDGET, SEARCH_BUDGET, EXCERPT, HIT_TEXT = 2000, 8000, 400, 500
GATES = {"skipped": 0, "partial": 1, "full": 2}
QKEY = [*SCOPE, "query_id"]


@dataclass
class MemoryTables:
    """The tables a search reads. Vectors stand in ``embedding`` beside ``embedding_model``."""

    episodes: DataFrame
    summaries: DataFrame
    facts: DataFrame
    entities: DataFrame
    memories: DataFrame
    relationships: DataFrame
    relations: DataFrame
    model: str | None = None


@dataclass
class Options:
    """What a deployment may change; the defaults are the usual ones."""

    budget: int = CONTEXT_BUDGET
    force: bool = False
    k: int = search.TOP_K
    lam: float = fusion.MMR_LAMBDA
    graph: bool = False


def _json(attributes: Column, missing: str) -> Column:
    """An attribute map as JSON, angle brackets and ampersands escaped."""
    text = F.to_json(attributes)
    for c, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(c), F.lit(code))
    return F.coalesce(text, F.lit(missing))


def memory_gate(searched: Column, found: Column) -> Column:
    """How much memory an answer got: ``skipped`` unsearched, ``full`` with anything found, else ``partial``."""
    return F.when(~searched, "skipped").when(found, "full").otherwise("partial")


def timeframe_backoff(hits: DataFrame, inside: Column) -> DataFrame:
    """Hits inside their query's timeframe; all of a query's hits when none is inside."""
    marked = hits.withColumn("_inside", F.coalesce(inside, F.lit(True)))
    some = marked.groupBy(*QKEY).agg(F.max("_inside").alias("_some"))
    return marked.join(some, QKEY).filter(F.col("_inside") | ~F.col("_some")).drop("_inside", "_some")


def at_once(*steps: Callable):
    """Results of steps that do not need each other; their jobs share the cores."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inherit(s)) for s in steps]]


class Search:
    """One batch search; every attribute is a DataFrame keyed by scope and query.

    The gate is worked out at once, everything found when it is asked for first.
    """

    def __init__(self, queries: DataFrame, tables: MemoryTables, *, as_of: Column, embed: Callable[[Column], Column], options: Options | None = None,
                 paraphrases: DataFrame | None = None, rerank_scores: DataFrame | None = None):
        self.t, self.as_of, self.opt, self.scores = tables, as_of, options or Options(), rerank_scores
        text = F.col("text")
        o = self.opt
        base = queries.select(
            *QKEY, "acting_kind", "acting_owner", "text", X.tokenize(text).alias("terms"), D.resolve_timeframe(text, as_of).alias("tf"),
            X.search_signal(text).alias("signal"), X.counting_intent(text).alias("is_counting"), X.ordering_intent(text).alias("is_ordering"),
            F.when(X.ordering_intent(text), search.WIDENED_SUMMARIES).otherwise(o.k).alias("k_summaries"),
            F.when(X.ordering_intent(text), search.WIDENED_SIMILARITY).otherwise(search.SUMMARY_SIMILARITY).alias("thr_summaries"),
            F.when(X.recommendation_intent(text), search.WIDENED_ENTITIES).otherwise(o.k).alias("k_entities"),
            F.when(X.recommendation_intent(text), search.WIDENED_SIMILARITY).otherwise(search.ENTITY_SIMILARITY).alias("thr_entities"),
        )
        self.attributes = materialize(current_attributes(tables.memories), "attributes")
        self.current = current_versions(tables.summaries)
        every = materialize(stage1_entity_match(base, tables.entities), "matches")
        frames = base.select(*QKEY, "tf")
        day = F.col("last_updated")
        inside = D.overlaps(day, F.date_add(day, 1), F.col("tf.start"), F.col("tf.end"))
        self.matched = every.join(frames, QKEY).filter(F.col("tf").isNull() | inside).drop("tf")
        sole = every.groupBy(*QKEY).agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("entity_id")).filter("_n = 1")
        has = self.matched.select(*QKEY).distinct().withColumn("has_match", F.lit(True))
        base = base.join(has, QKEY, "left").withColumn("has_match", F.coalesce("has_match", F.lit(False)))
        searched = (F.col("text") != "") & (F.col("has_match") | F.col("signal") | F.lit(o.force))
        base = base.withColumn("searched", searched)
        if "query_vector" in queries.columns:
            vectors = queries.select(*QKEY, "query_vector")
        else:
            vectors = V.embed_texts(base.filter("searched").select(*QKEY, "text"), QKEY, text, embed, "query_vector").drop("text")
        self.queries = materialize(base.join(vectors, QKEY, "left"), "queries")
        self.live = self.queries.filter("searched")
        self.variants = self._variants(paraphrases, embed)
        self._sole = sole

    def find_all(self) -> None:
        """All that an answer is made of, the parts that do not need each other side by side."""
        at_once(lambda: self.pick_facts, lambda: self.keyword_episodes, lambda: self.keyword_entities, lambda: self.counted)

    def _variants(self, paraphrases, embed):
        own = self.live.select(*QKEY, F.lit(0).alias("variant"), "query_vector")
        if paraphrases is None:
            return own
        rows = paraphrases.join(self.live.select(*QKEY), QKEY, "left_semi")
        if "query_vector" in rows.columns:
            return own.unionByName(rows.select(*QKEY, "variant", "query_vector"))
        said = V.embed_texts(rows.select(*QKEY, "variant", "text"), [*QKEY, "variant"], F.col("text"), embed, "query_vector")
        return own.unionByName(said.drop("text"))

    @cached_property
    def counted(self) -> DataFrame:
        """Every fact that names the one matched entity of a counting query."""
        asked = self.live.filter("is_counting").select(*QKEY).join(self._sole.select(*QKEY, "entity_id"), QKEY)
        names = self.t.entities.select(*SCOPE, "id", "name").join(asked.select(*SCOPE, F.col("entity_id").alias("id")).distinct(), [*SCOPE, "id"], "left_semi")
        found = exhaustive_count_facts(countable_facts(self.t.facts, self.t.summaries), names)
        named = names.select(*SCOPE, F.col("id").alias("entity_id"), F.col("name").alias("entity_name"))
        return asked.join(named, [*SCOPE, "entity_id"]).join(found, [*SCOPE, "entity_id"])

    def _vectors(self, df: DataFrame, ident: str = "id") -> DataFrame:
        return search.usable_model(df, self.t.model).select(*SCOPE, ident, F.col("embedding").alias("vector"))

    @cached_property
    def pool(self) -> DataFrame:
        """Fused candidates of the three summary channels."""
        o, over = self.opt, search.OVERFETCH
        k_max = max(search.WIDENED_SUMMARIES, o.k) * over
        limits = self.live.select(*QKEY, (F.col("k_summaries") * over).alias("k"), F.col("thr_summaries").alias("threshold"))
        asked = self.variants.join(limits, QKEY)

        def channel(vecs):
            hits = search.vector_topk(vecs, asked, k=k_max, query_cols=["query_id", "variant"])
            return search.rank_by_similarity(hits.groupBy(*QKEY, "id").agg(F.max("sim").alias("sim")))

        facts = self.t.facts.filter("grounded").join(self.current.select(*SCOPE, F.col("id").alias("summary_id")), [*SCOPE, "summary_id"], "left_semi")
        docs = self.current.filter("summary is not null").select(*SCOPE, F.col("id").alias("doc_id"), F.col("summary").alias("text"))
        words = self.live.select(*QKEY, "text", (F.col("k_summaries") * over).alias("k"))
        vec, fact, keyword = at_once(
            lambda: materialize(channel(self._vectors(self.current)), "vectors"),
            lambda: materialize(channel(self._vectors(facts, "summary_id").withColumnRenamed("summary_id", "id")), "factvectors"),
            lambda: materialize(bm25_topk(docs, words, k=k_max).withColumnRenamed("doc_id", "id"), "keywords"),
        )
        fused = fusion.rrf_fuse({"vector": vec, "keyword": keyword, "fact": fact})
        period = self.current.select(*SCOPE, "id", "period")
        pool = fused.join(period, [*SCOPE, "id"]).join(self.live.select(*QKEY, "tf", "k_summaries", "is_ordering"), QKEY)
        span = D.period_range(F.col("period"))
        known = pool.withColumn("_p", span).withColumn("_hit", D.overlaps(F.col("_p.start"), F.col("_p.end"), F.col("tf.start"), F.col("tf.end")))
        # an unreadable period is never excluded
        kept = timeframe_backoff(known, F.col("_hit"))
        boost = F.when(F.coalesce(F.col("_hit"), F.lit(False)), fusion.TIMEFRAME_BOOST).otherwise(0.0)
        pool = kept.withColumn("relevance", F.col("fused") + boost).drop("_p", "_hit")
        if self.scores is not None:
            pool = fusion.rerank_apply(pool, self.scores)
        return materialize(pool, "pool")

    @cached_property
    def picks(self) -> DataFrame:
        """Summaries shown, after the diversity selection."""
        o = self.opt
        pooled = self.current.join(self.pool.select(*SCOPE, "id").distinct(), [*SCOPE, "id"], "left_semi")
        # every candidate carries its summary's tokens to its query, so they are packed before they are repeated
        tokens = pooled.select(*SCOPE, "id", fusion.packed_tokens(X.token_set(F.coalesce("summary", F.lit("")))).alias("tokens"))
        ranked = fusion.mmr_select(self.pool.withColumn("k", F.col("k_summaries")).join(tokens, [*SCOPE, "id"]), k=o.k, lam=o.lam)
        info = self.pool.select(*QKEY, "id", "period", "vector_rank", "keyword_rank", "fact_rank")
        return materialize(ranked.join(info, [*QKEY, "id"]), "picks")

    @cached_property
    def pick_facts(self) -> DataFrame:
        """Live facts of the picked summaries in the order they are shown."""
        key = [*QKEY, "summary_id"]
        mine = self.picks.select(*QKEY, F.col("id").alias("summary_id"))
        live = unexpired(self.t.facts.filter("grounded"), self.as_of)
        shown = live.select(*SCOPE, "summary_id", F.col("id").alias("fact_id"), F.col("fact").alias("text"), "source_count", "is_inference", V.unit(F.col("embedding")).alias("embedding"), "embedding_model")
        rows = mine.join(shown, [*SCOPE, "summary_id"])
        # lengths are taken out once per vector, so each pair costs one product
        asked_unit = self.live.select(*QKEY, V.unit(F.col("query_vector")).alias("query_vector"))
        rows = rows.join(asked_unit, QKEY)
        same = F.col("embedding").isNotNull() & (F.lit(True) if self.t.model is None else F.coalesce(F.col("embedding_model") == self.t.model, F.lit(False)))
        fits = F.size("embedding") == F.size("query_vector")
        sim = F.when(same & fits, F.round(V.dot(F.col("embedding"), F.col("query_vector")), search.DIGITS)).when(same, F.lit(0.0))
        facts = rows.withColumn("similarity", sim).drop("embedding", "embedding_model", "query_vector")
        asked = mine.join(self.live.select(*QKEY, "text"), QKEY)
        ranked = fusion.keyfact_rank(facts, asked, key)
        counted = ranked.withColumn("n_facts", F.count(F.lit(1)).over(W.partitionBy(*key))).withColumn("lines_before", fusion.lines_before(key))
        return materialize(counted, "facts")

    def _in_time(self, hits: DataFrame) -> DataFrame:
        when = interactions(self.t.episodes).select(*SCOPE, "id", "ts")
        rows = hits.join(when, [*SCOPE, "id"]).join(self.live.select(*QKEY, "tf"), QKEY)
        day = F.to_date("ts")
        return timeframe_backoff(rows, F.when(F.col("tf").isNotNull(), (day >= F.col("tf.start")) & (day < F.col("tf.end")))).drop("tf")

    @cached_property
    def episodes(self) -> DataFrame:
        eps = interactions(self.t.episodes)
        near = search.vector_topk(self._vectors(eps), self.live.select(*QKEY, "query_vector"), k=self.opt.k, threshold=search.EPISODE_SIMILARITY)
        return materialize(self._in_time(near), "episodes")

    @cached_property
    def keyword_episodes(self) -> DataFrame:
        eps = interactions(self.t.episodes)
        said = eps.select(*SCOPE, F.col("id").alias("doc_id"), F.concat("input_text", F.lit(" "), "output_text").alias("text"))
        found = self.episodes.select(*QKEY, F.col("id").alias("doc_id"))
        kw = bm25_topk(said, self.live.select(*QKEY, "text"), k=self.opt.k, exclude=found).withColumnRenamed("doc_id", "id")
        return materialize(self._in_time(kw), "kwepisodes")

    def _ents(self) -> DataFrame:
        return self.t.entities.filter(F.col("kind") != "self_model")

    def _in_frame(self, hits: DataFrame) -> DataFrame:
        dated = self._ents().select(*SCOPE, "id", "name", "last_updated")
        span = D.overlaps(F.col("last_updated"), F.date_add("last_updated", 1), F.col("tf.start"), F.col("tf.end"))
        return hits.join(dated, [*SCOPE, "id"]).join(self.live.select(*QKEY, "tf"), QKEY).filter(F.col("tf").isNull() | span).drop("tf")

    @cached_property
    def entities(self) -> DataFrame:
        limits = self.live.select(*QKEY, "query_vector", F.col("k_entities").alias("k"), F.col("thr_entities").alias("threshold"))
        # matched entities are left out before the cut: search past them, then drop them
        n = materialize(self.matched.groupBy(*QKEY).agg(F.count(F.lit(1)).cast("int").alias("_n")), "nmatched")
        most = n.agg(F.max("_n")).first()[0] or 0
        wide = limits.withColumn("_k", F.col("k")).join(n, QKEY, "left").withColumn("k", F.col("k") + F.coalesce("_n", F.lit(0))).drop("_n")
        k_max = max(search.WIDENED_ENTITIES, self.opt.k)
        ent = search.vector_topk(self._vectors(self._ents()), wide, k=k_max + int(most))
        ent = search.exclude_found(ent, self.matched).join(wide.select(*QKEY, "_k"), QKEY)
        ent = top_per_key(ent, QKEY, [F.col("sim").desc(), F.col("id")], k_max, "rank").filter("rank <= _k").drop("_k")
        return materialize(self._in_frame(ent), "entities")

    @cached_property
    def keyword_entities(self) -> DataFrame:
        values = F.array_join(F.transform("attribute_rows", lambda r: F.concat(F.lit(" "), r["content"])), "")
        named = self._ents().join(self.attributes.withColumnRenamed("entity_id", "id"), [*SCOPE, "id"], "left")
        edocs = named.select(*SCOPE, F.col("id").alias("doc_id"), F.concat("name", F.coalesce(values, F.lit(""))).alias("text"))
        known = self.matched.select(*QKEY, "id").unionByName(self.entities.select(*QKEY, "id")).withColumnRenamed("id", "doc_id")
        kwe = bm25_topk(edocs, self.live.select(*QKEY, "text"), k=self.opt.k, exclude=known).withColumnRenamed("doc_id", "id")
        return materialize(self._in_frame(kwe), "kwentities")

    @cached_property
    def walked(self) -> DataFrame | None:
        if not self.opt.graph:
            return None
        seeds = reduce(DataFrame.unionByName, [d.select(*QKEY, "id") for d in (self.matched.join(self.live.select(*QKEY), QKEY, "left_semi"), self.entities, self.keyword_entities)])
        reached = graph_walk(self.t.relationships, seeds)
        return reached.join(self.t.entities.select(*SCOPE, "id", "name"), [*SCOPE, "id"])

    # The shown text.

    def _updated(self) -> Column:
        rel = D.relative_date_label(F.col("last_updated").cast("timestamp_ntz"), self.as_of)
        return F.when(rel != "", F.concat(F.lit(", last updated "), F.col("last_updated").cast("string"), F.lit(" ("), rel, F.lit(")"))).otherwise("")

    def _attrs(self, df: DataFrame) -> DataFrame:
        return df.join(self.attributes.select(*SCOPE, F.col("entity_id").alias("id"), "attributes"), [*SCOPE, "id"], "left")

    def lines(self) -> DataFrame:
        """Every line of the answers: scope, query_id, section, ord, line."""
        self.find_all()
        out = []

        def add(df, section, order, line):
            out.append(df.select(*QKEY, F.lit(section).alias("section"), order.cast("string").alias("ord"), line.alias("line")))

        place = lambda c: F.lpad(c.cast("string"), 10, "0")
        sessions = self.queries.select(*QKEY, "acting_kind", "acting_owner")
        anchor = self_model_anchor(sessions, self.t.entities, self.attributes, self.t.summaries)
        add(anchor.filter("anchor != ''"), 1, F.lit("0"), F.col("anchor"))
        matched = self._attrs(self.matched.join(self.live.select(*QKEY), QKEY, "left_semi"))
        ent = F.concat(F.lit("\nentity "), "id", self._updated(), F.lit(" ("), "name", F.lit("): "), _json(F.col("attributes"), "null"))
        add(matched, 2, F.col("id"), ent)
        total = self.counted.groupBy(*QKEY, "entity_name").agg(F.max("number").alias("n"))
        head = F.concat(F.lit("\nEvery recorded occurrence found for "), "entity_name", F.lit(" ("), F.col("n").cast("string"), F.lit(" total, deduplicated):"))
        add(total, 3, F.lit(""), head)
        # a line is at least one character, so later ones cannot be shown
        add(self.counted.filter(F.col("number") <= self.opt.budget), 3, place(F.col("number")), F.concat(F.lit("\n"), F.col("number").cast("string"), F.lit(". "), "period", F.lit(": "), "fact"))
        self._summary_lines(add, place)
        self._hit_lines(add, place)
        if self.walked is not None:
            w = self._attrs(self.walked)
            add(w, 10, F.concat(F.col("hop").cast("string"), "id"), F.concat(F.lit("\nentity "), "id", F.lit(" ("), "name", F.lit("): "), _json(F.col("attributes"), "null"), F.lit(", relationship graph")))
        return reduce(DataFrame.unionByName, out)

    def _summary_lines(self, add, place) -> None:
        # only what a line can show of facts and prose travels; a line is cut to the budget or to its depth
        longest = max(self.opt.budget, fusion.SUMMARY_DEPTH)
        shown = self.pick_facts.filter(fusion.may_be_shown(F.col("n_facts"), F.col("lines_before")))
        row = F.struct("fact_rank", "fact_id", F.substring("text", 1, longest).alias("text"), "most_relevant")
        packed = shown.groupBy(*QKEY, F.col("summary_id").alias("id")).agg(F.collect_list(row).alias("facts"), F.max("n_facts").alias("n_facts"))
        none = F.array().cast(packed.schema["facts"].dataType)
        prose = self.current.select(*SCOPE, "id", F.substring(F.coalesce("summary", F.lit("")), 1, fusion.PROSE_DEPTH + 1).alias("prose"))
        n = self.picks.groupBy(*QKEY).agg(F.count(F.lit(1)).alias("n_picks"))
        rows = self.picks.join(n, QKEY).join(packed, [*QKEY, "id"], "left").withColumn("facts", F.coalesce("facts", none)).join(prose, [*SCOPE, "id"])
        rel = D.relative_date_label(D.period_range(F.col("period"))["start"].cast("timestamp_ntz"), self.as_of)
        dated = F.when(F.coalesce(rel, F.lit("")) != "", F.concat(F.lit(", dated "), "period", F.lit(" ("), rel, F.lit(")"))).otherwise("")
        prefix = F.concat(F.lit("\nrelated memory (summary "), "id", dated, fusion.match_label(F.col("vector_rank"), F.col("keyword_rank")), F.lit("): "))
        share = fusion.guarantee_share(F.col("n_picks"), self.opt.budget)
        line = fusion.guarantee_line(prefix, F.col("prose"), F.col("facts"), share, F.coalesce("n_facts", F.lit(0)))
        depth = F.concat(F.lit("\n"), fusion.depth_text(F.col("prose"), F.col("facts")))
        two = F.array(F.struct(F.lit(4).alias("section"), line.alias("line")), F.struct(F.lit(5).alias("section"), depth.alias("line")))
        both = rows.select(*QKEY, "pick", F.explode(two).alias("_l"))
        add(both, F.col("_l.section"), place(F.col("pick")), F.col("_l.line"))

    def _exchange(self, hits: DataFrame) -> DataFrame:
        said = self.t.episodes.select(*SCOPE, "id", F.concat(F.lit("USER: "), "input_text", F.lit(" ASSISTANT: "), "output_text").alias("exchange"))
        return hits.join(said, [*SCOPE, "id"])

    def _hit_lines(self, add, place) -> None:
        rel = D.relative_date_label(F.col("ts").cast("timestamp_ntz"), self.as_of)
        dated = F.when(rel != "", F.concat(F.lit(", dated "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" ("), rel, F.lit(")"))).otherwise("")
        for hits, section, note in ((self.episodes, 6, ""), (self.keyword_episodes, 8, ", keyword match")):
            rows = self._exchange(hits).join(self.live.select(*QKEY, "terms"), QKEY)
            cut = X.centered_excerpt(F.col("exchange"), F.col("terms"), EXCERPT)
            add(rows, section, place(F.col("rank")), F.concat(F.lit("\nrelated exchange (episode "), "id", dated, F.lit(f"{note}): "), cut))
        for hits, section, note in ((self.entities, 7, ""), (self.keyword_entities, 9, ", keyword match")):
            rows = self._attrs(hits)
            line = F.concat(F.lit("\nrelated memory (entity "), "id", self._updated(), F.lit(", "), "name", F.lit(f"{note}): "), _json(F.col("attributes"), "{}"))
            add(rows, section, place(F.col("rank")), line)

    def context(self) -> DataFrame:
        """One row per query: scope, query_id, gate, context, needs_aggregation."""
        lines = materialize(self.lines(), "lines")
        first = top_per_key(lines, QKEY, [F.col("section"), F.col("ord")], self.opt.budget + 1)
        row = F.struct("section", "ord", "line")
        text = first.groupBy(*QKEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["line"]), "").alias("_text"), F.max("section").alias("_last"))
        count = self.counted.select(*QKEY).distinct().withColumn("_counted", F.lit(True))
        q = self.queries.join(text, QKEY, "left").join(count, QKEY, "left")
        gate = memory_gate(F.col("searched"), F.coalesce(F.col("_last"), F.lit(0)) > 1)
        # only what was searched is cut to the budget; an anchor alone is shown whole
        shown = F.when(F.col("searched"), X.truncate_budget(F.coalesce("_text", F.lit("")), self.opt.budget)).otherwise(F.coalesce("_text", F.lit("")))
        needs = F.col("searched") & (F.col("is_ordering") | F.coalesce("_counted", F.lit(False)))
        return q.select(*QKEY, gate.alias("gate"), shown.alias("context"), needs.alias("needs_aggregation"))

    def citations(self) -> DataFrame:
        """Every reference of the answers, long form: scope, query_id, section, ord, kind, ref scope,
        ref_id, snippet, parent_summary_id, relations, is_inference."""
        self.find_all()
        out = []

        def add(df, section, order, kind, ident, snippet, parent=None, inference=None, scope=("scope_kind", "scope_owner")):
            out.append(df.select(
                *QKEY, F.lit(section).alias("section"), order.cast("string").alias("ord"), F.lit(kind).alias("kind"), F.col(scope[0]).alias("ref_kind"), F.col(scope[1]).alias("ref_owner"),
                ident.alias("ref_id"), snippet.alias("snippet"), (parent if parent is not None else F.lit(None).cast("string")).alias("parent_summary_id"),
                (inference if inference is not None else F.lit(None).cast("boolean")).alias("is_inference"),
            ))

        place = lambda c: F.lpad(c.cast("string"), 10, "0")
        none = F.lit(None).cast("string")
        rows = self.attributes.select(*SCOPE, F.col("entity_id").alias("id"), F.explode("attribute_rows").alias("a"))

        def entity(df, section, order, label):
            add(df, section, F.concat(order, F.lit("#")), "entity", F.col("id"), none)
            attrs = df.join(rows, [*SCOPE, "id"])
            add(attrs, section, F.concat(order, F.lit("#"), F.col("a.attribute_key")), "memory", F.col("a.id"), F.concat(label, F.lit(": "), F.col("a.attribute_key"), F.lit(" = "), F.col("a.content")))

        selves = self.t.entities.filter(F.col("kind") == "self_model").groupBy(*SCOPE).agg(F.min("id").alias("id"))
        own = selves.join(rows, [*SCOPE, "id"], "left").select(F.col("scope_kind").alias("acting_kind"), F.col("scope_owner").alias("acting_owner"), "id", "a")
        mine = self.queries.select(*QKEY, "acting_kind", "acting_owner").join(own, ["acting_kind", "acting_owner"])
        acting = ("acting_kind", "acting_owner")
        add(mine.drop("a").distinct(), 1, F.lit("0#"), "entity", F.col("id"), none, scope=acting)
        add(mine.filter("a is not null"), 1, F.concat(F.lit("0#"), F.col("a.attribute_key")), "memory", F.col("a.id"), F.concat(F.lit("self_model: "), F.col("a.attribute_key"), F.lit(" = "), F.col("a.content")), scope=acting)
        label = F.concat(F.lit("entity "), "id")
        named = F.concat(label, F.lit(" ("), "name", F.lit(")"))
        entity(self.matched.join(self.live.select(*QKEY), QKEY, "left_semi").select(*QKEY, "id", "name"), 2, F.col("id"), label)
        add(self.counted, 3, place(F.col("number")), "memory", X.fact_memory_id(F.col("id")), F.col("fact"), parent=F.col("summary_id"))
        prose = self.current.select(*SCOPE, "id", "summary")
        add(self.picks.join(prose, [*SCOPE, "id"]), 4, place(F.col("pick")), "summary", F.col("id"), F.col("summary"))
        facts = self.pick_facts.join(self.picks.select(*QKEY, F.col("id").alias("summary_id"), "pick"), [*QKEY, "summary_id"])
        add(facts, 4, F.concat(place(F.col("pick")), F.lit("#"), F.lpad(F.col("fact_id").cast("string"), 20, "0")), "memory", X.fact_memory_id(F.col("fact_id")), F.col("text"), parent=F.col("summary_id"), inference=F.col("is_inference"))
        for hits, section in ((self.episodes, 6), (self.keyword_episodes, 8)):
            add(self._exchange(hits), section, place(F.col("rank")), "episode", F.col("id"), F.col("exchange"))
        for hits, section in ((self.entities, 7), (self.keyword_entities, 9)):
            entity(hits.select(*QKEY, "id", "name", "rank"), section, place(F.col("rank")), named)
        if self.walked is not None:
            entity(self.walked.select(*QKEY, "id", "name", "hop"), 10, F.concat(F.col("hop").cast("string"), "id"), label)
        refs = reduce(DataFrame.unionByName, out)
        linked = relations_of(
            refs.filter("section = 4 and kind = 'memory'").select(F.col("ref_kind").alias("scope_kind"), F.col("ref_owner").alias("scope_owner"), F.col("ref_id").alias("memory_id")).distinct(), self.t.relations
        ).select(F.col("scope_kind").alias("ref_kind"), F.col("scope_owner").alias("ref_owner"), F.col("memory_id").alias("ref_id"), "relations").filter(F.size("relations") > 0)
        return refs.join(linked, ["ref_kind", "ref_owner", "ref_id"], "left")


def retrieve_batch(queries: DataFrame, tables: MemoryTables, *, as_of: Column, embed, options: Options | None = None, **extra) -> Search:
    """Search for every query; ``context()`` gives gate and text, ``citations()`` the references.

    ``queries``: query_id, acting_kind, acting_owner, scope (the workspace), text and, where it is known
    already, query_vector.
    """
    return Search(queries, tables, as_of=as_of, embed=embed, options=options, **extra)


def search_batch(queries: DataFrame, tables: MemoryTables, *, as_of: Column, embed, limit: int = 10, budget: int = SEARCH_BUDGET, **extra) -> DataFrame:
    """Forced search: the first ``limit`` cited hits per query, standing anchors not counted."""
    s = Search(queries, tables, as_of=as_of, embed=embed, options=Options(budget=budget, force=True), **extra)
    hits = s.citations().filter("section > 1 and snippet is not null")
    top = top_per_key(hits, QKEY, [F.col("section"), F.col("ord")], limit, "rank")
    return top.select(*QKEY, "rank", "kind", "ref_id", X.hard_truncate(F.col("snippet"), HIT_TEXT).alias("text"), "parent_summary_id", "is_inference")


def selfcheck(probes: DataFrame, tables: MemoryTables, *, as_of: Column, embed) -> DataFrame:
    """Probes with what went wrong: query_id, passed, gate, detail.

    ``probes``: query_id, scope, text, expect_min_gate, expect_max_gate, expect_substring (NULL for
    no expectation). Each probe acts inside its own scope.
    """
    q = probes.select("query_id", *SCOPE, "text", F.col("scope_kind").alias("acting_kind"), F.col("scope_owner").alias("acting_owner"))
    got = Search(q, tables, as_of=as_of, embed=embed).context()
    return judge_probes(probes.join(got, QKEY))


def judge_probes(rows: DataFrame) -> DataFrame:
    def rank(c):
        return reduce(lambda acc, g: acc.when(F.col(c) == g, GATES[g]), GATES, F.when(F.lit(False), -1))

    have, low, high = rank("gate"), rank("expect_min_gate"), rank("expect_max_gate")

    def quoted(c):
        return F.concat(F.lit('"'), F.col(c), F.lit('"'))

    reasons = F.array_compact(F.array(
        F.when(have < low, F.concat(F.lit("gate was "), quoted("gate"), F.lit(", wanted at least "), quoted("expect_min_gate"))),
        F.when(have > high, F.concat(F.lit("gate was "), quoted("gate"), F.lit(", wanted at most "), quoted("expect_max_gate"))),
        F.when(~F.contains(F.lower("context"), F.lower("expect_substring")), F.concat(F.lit("expected retrieved context to contain "), quoted("expect_substring"), F.lit(", it didn't"))),
    ))
    rows = rows.withColumn("_reasons", reasons)
    return rows.select("query_id", (F.size("_reasons") == 0).alias("passed"), "gate", F.when(F.size("_reasons") == 0, "ok").otherwise(F.array_join("_reasons", "; ")).alias("detail"))
