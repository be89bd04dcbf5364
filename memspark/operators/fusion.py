"""Rank fusion, diversity selection and ranking of the facts inside a summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memspark.functions.text import hard_truncate, tokenize, truncate_budget
from memspark.operators import kernels
from memspark.operators.bm25 import idf, term_weight
from memspark.operators.scope import SCOPE

# Fusion, diversity and fact parameters.
RRF_K = 1.0
MMR_LAMBDA = 0.7
TIMEFRAME_BOOST = 0.5
FACT_MARGIN = 0.1
GUARANTEE_ALL, GUARANTEE_PROSE = 3, 300
GUARANTEE_SHARE, GUARANTEE_MIN, GUARANTEE_FACT_MIN = 0.5, 220, 60
PROSE_DEPTH, SUMMARY_DEPTH = 500, 700


def reciprocal_rank(rank: Column) -> Column:
    """Weight of a 0-based rank; 0 where the channel did not find the row."""
    return F.when(rank.isNull(), F.lit(0.0)).otherwise(1.0 / (RRF_K + rank + 1))


def rrf_fuse(channels: dict[str, DataFrame], *, boosted: DataFrame | None = None, keys: list[str] = SCOPE) -> DataFrame:
    """One row per candidate with each channel's rank and the fused score.

    ``channels``: name -> keys, query_id, id, rank. ``boosted``: candidates inside the query's
    timeframe, which get a fixed bonus.
    """
    cols = [*keys, "query_id", "id"]
    rows = [
        df.select(*cols, *[(F.col("rank") if n == name else F.lit(None)).cast("int").alias(f"{n}_rank") for n in channels])
        for name, df in channels.items()
    ]
    merged = reduce(DataFrame.unionByName, rows).groupBy(*cols).agg(*[F.min(f"{n}_rank").alias(f"{n}_rank") for n in channels])
    fused = reduce(lambda a, b: a + b, [reciprocal_rank(F.col(f"{n}_rank")) for n in channels])
    if boosted is not None:
        marks = boosted.select(*cols).distinct().withColumn("_in", F.lit(True))
        merged = merged.join(marks, cols, "left")
        fused = fused + F.when(F.col("_in"), F.lit(TIMEFRAME_BOOST)).otherwise(F.lit(0.0))
    out = merged.withColumn("fused", fused)
    return out.drop("_in") if boosted is not None else out


def match_label(vector_rank: Column, keyword_rank: Column) -> Column:
    return (
        F.when(vector_rank.isNotNull() & keyword_rank.isNotNull(), F.lit(", vector+keyword match"))
        .when(keyword_rank.isNotNull(), F.lit(", keyword match"))
        .otherwise(F.lit(""))
    )


def rerank_apply(pool: DataFrame, scores: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """Replace ``relevance`` by a supplied score where there is one and the pool has two rows or more.

    ``pool`` carries ``is_ordering``; only ordering queries are re-ranked.
    """
    cols = [*keys, "query_id", "id"]
    size = pool.groupBy(*keys, "query_id").agg(F.count(F.lit(1)).alias("_pool"))
    joined = pool.join(size, [*keys, "query_id"]).join(scores.select(*cols, F.col("score").alias("_score")), cols, "left")
    use = F.col("is_ordering") & (F.col("_pool") > 1) & F.col("_score").isNotNull()
    return joined.withColumn("relevance", F.when(use, F.col("_score")).otherwise(F.col("relevance"))).drop("_pool", "_score")


def packed_tokens(tokens: Column) -> Column:
    """A token set as a few bytes, for :func:`mmr_select`; packed once a row before rows are repeated by a join."""
    each = F.transform(F.array_sort(F.array_distinct(tokens)), lambda w: F.concat(w, F.lit("\0")))
    return kernels.packed_tokens()(F.array_join(each, ""))


def mmr_select(pool: DataFrame, *, k: int = 5, lam: float = MMR_LAMBDA, keys: list[str] = SCOPE) -> DataFrame:
    """Picked rows with ``pick`` (from 0). ``pool``: keys, query_id, id, relevance, tokens (packed or not), optional k.

    Greedy: each step takes the best trade of relevance against the highest token overlap with what
    is picked, smaller ids winning ties. A pool that fits is only sorted. A query's pool is at most
    three channels of three times k rows, so it travels as one row and no further shuffle is needed.
    """
    own_k = F.max("k") if "k" in pool.columns else F.lit(k)
    tokens = F.col("tokens") if dict(pool.dtypes)["tokens"] == "binary" else packed_tokens(F.col("tokens"))
    item = F.struct("id", "relevance", tokens.alias("tokens"))
    packed = pool.groupBy(*keys, "query_id").agg(F.array_sort(F.collect_list(item)).alias("_pool"), own_k.cast("int").alias("_k"))
    order = kernels.mmr_order(lam)
    chosen = packed.withColumn("_order", order(F.transform("_pool", lambda p: p["relevance"]), F.transform("_pool", lambda p: p["tokens"]), "_k"))
    rows = chosen.select(*keys, "query_id", "_pool", F.posexplode("_order").alias("pick", "_at"))
    picked = F.col("_pool")[F.col("_at")]
    return rows.select(*keys, "query_id", picked["id"].alias("id"), picked["relevance"].alias("relevance"), "pick")


def fact_lexical_scores(facts: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Facts with ``score`` and ``asks``: BM25 without length folding inside one summary.

    ``facts``: keys, fact_id, text and whatever else; ``queries``: keys, text. A fact without a match
    scores 0. Facts and query meet once by ``keys``; the counts after that are windows and sums
    inside that partitioning, so nothing is shuffled again. Texts are cut into terms where they met, and of a fact's
    matched terms only the first carries the fact's other columns along, so a task sorts little more than the texts.
    """
    rest = [c for c in facts.columns if c not in (*keys, "fact_id")]
    rows = facts.select(*keys, "fact_id", *rest, F.col("text").alias("_said")).repartition(*keys)
    rows = rows.join(queries.select(*keys, tokenize(F.col("text")).alias("_asked")), keys, "inner")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    rows = rows.withColumn("_said", F.filter(tokenize(F.col("_said")), lambda w: F.array_contains(F.col("_asked"), w)))

    def times(w: Column, where: str) -> Column:
        return F.size(F.filter(where, lambda x: x == w))

    terms = F.transform(F.array_distinct("_said"), lambda w: F.struct(w.alias("term"), times(w, "_said").alias("tf"), times(w, "_asked").alias("times")))
    asks = (F.size("_asked") > 0).alias("asks")
    hits = rows.select(*keys, "fact_id", *rest, asks, "_n", F.posexplode_outer(terms).alias("_pos", "_t"))
    once = [F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col(c)).alias(c) for c in rest]
    hits = hits.select(*keys, "fact_id", *once, "asks", "_n", F.col("_t.term").alias("_term"), F.col("_t.tf").alias("_tf"), F.col("_t.times").alias("_times"))
    kept = [F.first(c, ignorenulls=True).alias(c) for c in rest]
    tf = hits.groupBy(*keys, "fact_id", "_term").agg(F.sum("_tf").alias("_tf"), *[F.first(c).alias(c) for c in ("_times", "_n", "asks")], *kept)
    tf = tf.withColumn("_df", F.count(F.lit(1)).over(W.partitionBy(*keys, "_term")))
    weight = term_weight(F.col("_tf"), idf(F.col("_n"), F.col("_df")), F.lit(1.0), F.lit(1.0), b=0)
    gain = F.when(F.col("_term").isNotNull(), F.col("_times") * weight).otherwise(0.0)
    return tf.groupBy(*keys, "fact_id").agg(*kept, F.round(F.sum(gain), 9).alias("score"), F.first("asks").alias("asks"))


def keyfact_rank(facts: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Facts of each (query, summary) in the order they are shown, with the marked one.

    ``facts``: keys, fact_id, text, similarity, source_count; ``queries``: keys, text. Adds
    ``lex_score``, ``fact_rank`` (from 0) and ``most_relevant``. Lexical order, fused with the
    semantic order when every fact of the summary has a similarity. The windows hold the facts of
    one summary, which came from one text.
    """
    scored = fact_lexical_scores(facts, queries, keys).withColumnRenamed("asks", "_asks")
    group = W.partitionBy(*keys)
    lex_score = F.when(F.col("_asks"), F.col("score")).otherwise(0.0)
    lex_count = F.when(F.col("_asks"), F.col("source_count")).otherwise(0)
    rows = scored.withColumn("_lex", F.row_number().over(group.orderBy(lex_score.desc(), lex_count.desc(), "fact_id")) - 1)
    rows = rows.withColumn("_sem", F.row_number().over(group.orderBy(F.col("similarity").desc_nulls_last(), "fact_id")) - 1)
    rows = rows.withColumn("_semantic", F.min(F.col("similarity").isNotNull()).over(group))
    fused = reciprocal_rank(F.col("_lex")) + reciprocal_rank(F.col("_sem"))
    rows = rows.withColumn("_fused", F.when(F.col("_semantic"), F.round(fused, 9)))
    order = [F.col("_fused").desc_nulls_last(), F.when(F.col("_semantic"), F.col("source_count")).otherwise(0).desc(), F.when(F.col("_semantic"), F.lit(0)).otherwise(F.col("_lex")), F.col("fact_id")]
    rows = rows.withColumn("fact_rank", F.row_number().over(group.orderBy(*order)) - 1)
    by_rank = group.orderBy("fact_rank")
    shown = F.when(F.col("_semantic"), F.col("_fused")).otherwise(lex_score)
    rows = rows.withColumn("_shown", shown).withColumn("_next", F.lead("_shown").over(by_rank))
    gap = F.round(F.col("_shown") - F.col("_next"), 9)
    marked = F.when(F.col("_semantic"), gap >= FACT_MARGIN).otherwise(F.col("_asks") & (F.col("_shown") > 0) & (gap > 0))
    rows = rows.withColumn("most_relevant", (F.col("fact_rank") == 0) & F.coalesce(marked, F.lit(False)))
    return rows.withColumnRenamed("score", "lex_score").drop("_asks", "_lex", "_sem", "_semantic", "_fused", "_shown", "_next")


def guarantee_share(n_picks: Column, budget: int = 2000) -> Column:
    share = F.floor(F.floor(F.lit(budget * GUARANTEE_SHARE)) / n_picks)
    return F.greatest(share, F.lit(GUARANTEE_MIN)).cast("int")


def lines_before(keys: list[str]) -> Column:
    """Characters of the :func:`depth_text` lines before a ranked fact's own."""
    earlier = W.partitionBy(*keys).orderBy("fact_rank").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.length("text") + len("\n  - ")).over(earlier), F.lit(0))


def may_be_shown(n_facts: Column, before: Column) -> Column:
    """Whether any text of a summary can hold the fact: few facts are all told, others by rank until a line's room is used up."""
    return (n_facts <= GUARANTEE_ALL) | (before < SUMMARY_DEPTH)


def guaranteed_fact(prose: Column, facts: Column, n_facts: Column | None = None) -> Column:
    """Text every picked summary gets: few facts whole, else the first ranked one, else its prose.

    ``facts``: array of struct(fact_rank, fact_id, text, most_relevant); with ``n_facts``, how many there are, those that may be shown do.
    """
    n = F.size(facts) if n_facts is None else n_facts
    in_order = F.array_sort(F.transform(facts, lambda f: F.struct(f["fact_id"].alias("i"), f["text"].alias("t"))))
    first = F.array_sort(F.transform(facts, lambda f: F.struct(f["fact_rank"].alias("r"), f["text"].alias("t"))))
    return (
        F.when(n == 0, truncate_budget(prose, GUARANTEE_PROSE))
        .when(n <= GUARANTEE_ALL, F.array_join(F.transform(in_order, lambda f: f["t"]), " "))
        .otherwise(F.try_element_at(first, F.lit(1))["t"])
    )


def guarantee_line(prefix: Column, prose: Column, facts: Column, share: Column, n_facts: Column | None = None) -> Column:
    room = F.greatest(share - F.octet_length(prefix), F.lit(GUARANTEE_FACT_MIN))
    return F.concat(prefix, hard_truncate(guaranteed_fact(prose, facts, n_facts), room))


def depth_text(prose: Column, facts: Column) -> Column:
    """Ranked facts, one per line with the marked one named, then the start of the prose."""
    ordered = F.array_sort(F.transform(facts, lambda f: F.struct(f["fact_rank"].alias("r"), f["text"].alias("t"), f["most_relevant"].alias("m"))))
    lines = F.transform(ordered, lambda f: F.concat(F.when(f["m"], F.lit("\n  - (most relevant) ")).otherwise(F.lit("\n  - ")), f["t"]))
    return hard_truncate(F.concat(F.array_join(lines, ""), F.lit("\n"), truncate_budget(prose, PROSE_DEPTH)), SUMMARY_DEPTH)
