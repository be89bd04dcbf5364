"""Keyword search: term statistics and BM25 scores for whole batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.text import tokenize
from memspark.operators import kernels
from memspark.operators.cells import cut_into_cells, match_cells
from memspark.operators.running import top_per_key
from memspark.operators.scope import SCOPE
from memspark.session import materialize

# Score parameters.
K1, B = 1.5, 0.75
DIGITS = 6
POSTINGS_PER_CELL, TERMS_PER_CELL = 1 << 19, 1 << 17
#: Of packed rows, which are a fraction of the size.
PACKED_POSTINGS, PACKED_TERMS, SPREAD = 1 << 22, 1 << 21, 16
FEW_TERMS = 50_000


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def term_weight(tf: Column, idf_: Column, doc_len: Column, avg_len: Column, b: float = B, k1: float = K1) -> Column:
    """Score one occurrence of a query term adds to a document."""
    fold = F.lit(1.0) if b == 0 else (1 - b) + b * doc_len / avg_len
    return idf_ * tf * (k1 + 1) / (tf + k1 * fold)


def doc_tokens(docs: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """keys, doc_id, terms from keys, doc_id, text."""
    return docs.select(*keys, "doc_id", tokenize(F.col("text")).alias("terms"))


def corpus_stats(tokens: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """Documents and mean length per corpus."""
    return tokens.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("terms")).alias("avg_len")
    )


def bm25_stats(docs: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """Document frequency of every term with its corpus' size and mean length."""
    tokens = doc_tokens(docs, keys)
    terms = tokens.select(*keys, F.explode(F.array_distinct("terms")).alias("term"))
    df = terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(corpus_stats(tokens, keys), keys, "inner")


def query_terms(queries: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """One row per query and distinct term, with how often the query says it."""
    extra = [c for c in queries.columns if c not in (*keys, "query_id", "text")]
    rows = queries.select(*keys, "query_id", *extra, F.explode(tokenize(F.col("text"))).alias("term"))
    return rows.groupBy(*keys, "query_id", *extra, "term").agg(F.count(F.lit(1)).alias("times"))


def numbered_terms(terms: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """keys, term, ``no``: every asked term with a number of its own, written once."""
    numbers = materialize(terms.select(*keys, "term").distinct().withColumn("no", F.monotonically_increasing_id()), "asked")
    # written terms are small on disk and large as rows: Spark, which judges by the file, would broadcast too many
    return numbers if numbers.count() <= FEW_TERMS else numbers.hint("merge")


def by_number(rows: DataFrame, numbers: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """Rows of the numbered terms, ``term`` replaced by its number."""
    return rows.join(numbers, [*keys, "term"], "inner").withColumn("term", F.col("no")).drop("no")


def matching_postings(tokens: DataFrame, terms: DataFrame, keys: list[str] = SCOPE, numbers: DataFrame | None = None) -> DataFrame:
    """Term counts per document, only for terms some query of the corpus asks for; with ``numbers``, by number."""
    said = tokens.select(*keys, "doc_id", F.size("terms").alias("doc_len"), F.explode("terms").alias("term"))
    said = said.join(terms.select(*keys, "term").distinct(), [*keys, "term"], "left_semi") if numbers is None else by_number(said, numbers, keys)
    return said.groupBy(*keys, "doc_id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def packed_postings(docs: DataFrame, terms: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """A row per document, written: keys, doc_id, doc_len, ``words`` (64-bit hashes of its different terms) and ``tfs``.

    Where few terms are asked, only those are kept; documents without any stay for their length. Rows of one id and
    length count as one document.
    """
    asked = materialize(terms.select(F.xxhash64("term").alias("word")).distinct(), "asked")
    few = None if asked.count() > FEW_TERMS else [r["word"] for r in asked.collect()]
    hashed = docs.select(*keys, "doc_id", F.transform(tokenize(F.col("text")), lambda w: F.xxhash64(w)).alias("_all"))
    rows = hashed.select(*keys, "doc_id", kernels.counted_words(few)("_all").alias("_p"))
    rows = materialize(rows.select(*keys, "doc_id", "_p.doc_len", "_p.words", "_p.tfs"), "postings")
    same = [*keys, "doc_id", "doc_len"]
    twice = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    if twice.isEmpty():
        return rows.withColumn("copies", F.lit(1).cast("long"))
    said = rows.select(*same, F.explode(F.arrays_zip("words", "tfs")).alias("_p")).groupBy(*same, "_p.words").agg(F.sum("_p.tfs").cast("int").alias("tfs"))
    lists = said.groupBy(*same).agg(F.collect_list(F.struct("words", "tfs")).alias("_p"))
    whole = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).join(lists, same, "left")
    none = [F.coalesce(F.col(f"_p.{c}"), F.array().cast(f"array<{t}>")).alias(c) for c, t in (("words", "bigint"), ("tfs", "int"))]
    return materialize(whole.select(*same, *none, "copies"), "postings")


def scored_terms(terms: DataFrame, posts: DataFrame, keys: list[str] = SCOPE, exclude: DataFrame | None = None) -> DataFrame:
    """Query terms (``word``) with ``idf`` and the mean length of the query's corpus.

    With ``exclude`` (keys, query_id, doc_id) a query's corpus lacks those documents: they are taken
    off its counts, so the statistics are those of the smaller corpus. Statistics join the few query
    terms, never the postings.
    """
    df = posts.select(*keys, F.explode("words").alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("df"))
    stats = posts.groupBy(*keys).agg(F.sum("copies").alias("n_docs"), F.sum(F.col("copies") * F.col("doc_len")).alias("total_len"))
    rows = terms.join(df, [*keys, "word"], "inner").join(stats, keys, "inner")
    if exclude is not None:
        gone = exclude.select(*keys, "query_id", "doc_id").distinct().join(posts.select(*keys, "doc_id", "doc_len", "copies", "words"), [*keys, "doc_id"])
        off = gone.groupBy(*keys, "query_id").agg(
            F.sum("copies").alias("_n"), F.sum(F.col("copies") * F.col("doc_len")).alias("_len"), F.collect_set("doc_id").alias("skip")
        )
        asked = terms.groupBy(*keys, "query_id").agg(F.collect_list("word").alias("_asked"))
        off_df = gone.join(asked, [*keys, "query_id"]).select(*keys, "query_id", F.explode(F.array_intersect("words", "_asked")).alias("word"))
        off_df = off_df.groupBy(*keys, "query_id", "word").agg(F.count(F.lit(1)).alias("_df"))
        rows = rows.join(off, [*keys, "query_id"], "left").join(off_df, [*keys, "query_id", "word"], "left")
        for c, o in (("n_docs", "_n"), ("total_len", "_len"), ("df", "_df")):
            rows = rows.withColumn(c, F.col(c) - F.coalesce(o, F.lit(0))).drop(o)
    rows = rows.filter((F.col("df") > 0) & (F.col("total_len") > 0))
    rows = rows.withColumn("idf", idf(F.col("n_docs"), F.col("df"))).withColumn("avg_len", F.col("total_len") / F.col("n_docs"))
    return rows.drop("n_docs", "total_len", "df")


def bm25_topk(
    docs: DataFrame, queries: DataFrame, *, k: int = 5, b: float = B, k1: float = K1, keys: list[str] = SCOPE, exclude: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` best documents of each query's corpus: keys, query_id, doc_id, score, rank (from 0).

    ``queries`` may carry its own ``k`` column (at most ``k``). Scores are compared at six digits
    and equal scores go by id. ``exclude`` names documents that are not in a query's corpus.
    """
    own_k = queries if "k" in queries.columns else queries.withColumn("k", F.lit(k))
    terms = query_terms(own_k.select(*keys, "query_id", "k", "text"), keys)
    posts = packed_postings(docs, terms, keys)
    scored = scored_terms(terms.withColumn("word", F.xxhash64("term")).drop("term"), posts, keys, exclude)
    # rows go to the cells of all blocks of the other side: a document and a query are one row each
    said = F.sort_array(F.collect_list(F.struct("word", (F.col("times") * F.col("idf") * (k1 + 1)).alias("weight"))))
    once = ["k", "avg_len"] if exclude is None else ["k", "avg_len", "skip"]
    asked = scored.groupBy(*keys, "query_id").agg(said.alias("_t"), *[F.first(c).alias(c) for c in once])
    asked = materialize(asked.select(*keys, "query_id", F.col("_t.word").alias("words"), F.col("_t.weight").alias("weights"), *once), "askedterms")
    left, right, cell = cut_into_cells(
        posts.drop("copies").filter(F.size("words") > 0), asked, keys, ["doc_id"], ["query_id"], PACKED_POSTINGS, PACKED_TERMS,
        left_size=F.size("words"), right_size=F.size("words"), left_spread=SPREAD,
    )
    types = dict(docs.dtypes) | {"query_id": dict(queries.dtypes)["query_id"]}
    schema = ", ".join([f"{c} {types[c]}" for c in (*keys, "query_id", "doc_id")] + ["score double"])
    found = match_cells(left, right, cell, kernels.bm25_best(keys, DIGITS, b, k1), schema)
    ranked = top_per_key(found, [*keys, "query_id"], [F.col("score").desc(), F.col("doc_id")], k, "rank")
    ranked = ranked.withColumn("rank", F.col("rank") - 1)
    if "k" in queries.columns:
        ranked = ranked.join(queries.select(*keys, "query_id", "k"), [*keys, "query_id"], "inner").filter("rank < k").drop("k")
    return ranked
