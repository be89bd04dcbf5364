"""Entity names inside texts, and looking entities up by what a user typed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as X
from memspark.functions import timeex as D
from memspark.operators.running import top_per_key
from memspark.operators.scope import SCOPE
from memspark.session import materialize

MAX_CANDIDATES = 6
#: Longest character grams that names are filed under, and what parts words.
GRAM, BLANKS = 3, r"\s+"


def _grams(text: Column, lengths: range) -> Column:
    """Distinct character grams of short strings."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in lengths]))


def pieces_in_words(words: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, word, piece) where the piece occurs inside the word. Both are written and distinct.

    A piece is filed under its gram that the fewest words hold; the grams of the words fetch the pieces, and only
    those are looked for. Written words are small on disk and their grams many, so no side is left to be broadcast.
    How many words hold a gram is counted before the shuffle.
    """
    shortest, longest = pieces.agg(F.min(F.length("piece")), F.max(F.length("piece"))).first()
    found = [words.select(*keys, "word", F.col("word").alias("piece")).filter(F.lit(False))]
    for lengths, some in ((range(GRAM, GRAM + 1), F.length("piece") >= GRAM), (range(1, GRAM), F.length("piece") < GRAM)):
        if shortest is None or (longest < GRAM if lengths[0] == GRAM else shortest >= GRAM):
            continue
        of_words = words.select(*keys, "word", F.explode(_grams(F.col("word"), lengths)).alias("gram"))
        own = _grams(F.col("piece"), lengths) if lengths[0] == GRAM else F.array("piece")
        of_pieces = pieces.filter(some).select(*keys, "piece", F.explode(own).alias("gram"))
        counts = of_words.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
        filed = of_pieces.hint("merge").join(counts.hint("merge"), [*keys, "gram"]).groupBy(*keys, "piece").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
        found.append(of_words.hint("merge").join(filed, [*keys, "gram"]).filter(F.contains("word", "piece")).select(*keys, "word", "piece"))
    return reduce(DataFrame.unionByName, found)


def each_once(hits: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, text_id, name_id) from (keys, text_id, ``no``); a task sends all it found in a text as one row."""
    once = hits.groupBy(*keys, "text_id").agg(F.collect_set("no").alias("_nos")).select(*keys, "text_id", F.explode("_nos").alias("no"))
    return once.join(ids.hint("merge"), [*keys, "no"]).select(*keys, "text_id", "name_id")


def names_in_texts(texts: DataFrame, names: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """(keys, text_id, name_id) where the name occurs anywhere in the text of its scope.

    Containment has no key to join on, but a piece of a name without blanks can only lie inside a word. So each
    name goes by its longest piece, pieces meet the vocabulary of the texts and not the texts, and the words
    that hold one lead back to the texts. Names of several pieces are then looked for in the texts they may be in.
    What is found is many times the texts, so names go by number until it is known once.
    """
    parts = F.filter(F.split("name", BLANKS), lambda p: p != "")
    longest = F.array_max(F.transform(parts, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("at"), p.alias("piece"))))["piece"]
    given = names.select(*keys, "name_id", "name").filter(F.col("name") != "").distinct()
    ids = materialize(given.select(*keys, "name_id").distinct().withColumn("no", F.monotonically_increasing_id()), "nameids")
    named = materialize(given.join(ids, [*keys, "name_id"]).select(*keys, "no", "name", longest.alias("piece")), "named")
    words = texts.select(*keys, "text_id", F.explode(F.array_distinct(F.split("text", BLANKS))).alias("word")).filter("word != ''")
    vocabulary = materialize(words.select(*keys, "word").distinct(), "vocabulary")
    pieces = materialize(named.filter("piece is not null").select(*keys, "piece").distinct(), "pieces")
    # words, pieces and names are distinct, so pairs are; a name that is its piece is told by its number
    alone = F.col("name") == F.col("piece")
    pairs = pieces_in_words(vocabulary, pieces, keys).hint("merge").join(named, [*keys, "piece"]).select(*keys, "word", "no", F.when(~alone, F.col("name")).alias("name"), alone.alias("alone"))
    pairs = materialize(pairs, "pairs")
    whole = words.join(pairs.filter("alone").hint("merge"), [*keys, "word"]).select(*keys, "text_id", "no")
    if named.filter("piece is null or piece != name").isEmpty():
        return each_once(whole, ids, keys)
    maybe = words.join(pairs.filter("NOT alone").hint("merge"), [*keys, "word"]).select(*keys, "text_id", "no", "name").distinct()
    rows = texts.select(*keys, "text_id", "text")
    long = rows.join(maybe, [*keys, "text_id"])
    # a name of blanks alone has no piece and meets all texts of its scope
    blank = named.filter("piece is null").select(*keys, "no", "name")
    if not blank.isEmpty():
        long = long.unionByName(rows.join(blank, keys))
    long = long.filter(F.contains("text", "name"))
    return each_once(whole.unionByName(long.select(*keys, "text_id", "no")), ids, keys)


def stage1_entity_match(queries: DataFrame, entities: DataFrame, as_of=None, keys: list[str] = SCOPE) -> DataFrame:
    """Entities whose name or slug a query mentions: keys, query_id, id, name, last_updated.

    With ``as_of``, a query with a spoken timeframe keeps only entities updated inside it. Entities and queries grow
    with the tables, so neither is gathered in the driver to be broadcast.
    """
    live = entities.filter(F.col("kind") != "self_model")
    spelled = F.array_distinct(F.array(F.lower("name"), F.lower(X.slug_part(F.col("id")))))
    names = live.select(*keys, F.col("id").alias("name_id"), F.explode(spelled).alias("name"))
    texts = queries.select(*keys, F.col("query_id").alias("text_id"), F.lower("text").alias("text"))
    hits = names_in_texts(texts, names, keys).select(*keys, F.col("text_id").alias("query_id"), F.col("name_id").alias("id"))
    out = hits.join(live.select(*keys, "id", "name", "last_updated").hint("merge"), [*keys, "id"], "inner")
    if as_of is None:
        return out
    frames = queries.select(*keys, "query_id", D.resolve_timeframe(F.col("text"), as_of).alias("_tf"))
    inside = D.overlaps(F.col("last_updated"), F.date_add("last_updated", 1), F.col("_tf.start"), F.col("_tf.end"))
    return out.join(frames.hint("merge"), [*keys, "query_id"], "inner").filter(F.col("_tf").isNull() | inside).drop("_tf")


def known_entities(texts: DataFrame, entities: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """Entities whose name occurs in a period's source text. ``texts``: keys, text_id, text."""
    live = entities.filter(F.col("kind") != "self_model")
    names = live.select(*keys, F.col("id").alias("name_id"), F.lower("name").alias("name"))
    low = texts.select(*keys, "text_id", F.lower("text").alias("text"))
    return names_in_texts(low, names, keys).withColumnRenamed("name_id", "id")


def touching(summaries: DataFrame, wanted: DataFrame, keys: list[str] = SCOPE) -> DataFrame:
    """Summaries that touch a wanted entity (keys, entity_id), each once."""
    touched = summaries.select(*keys, "id", F.explode("entities_touched").alias("entity_id"))
    ids = touched.join(wanted, [*keys, "entity_id"], "left_semi").select(*keys, "id").distinct()
    return summaries.join(ids, [*keys, "id"], "left_semi")


def entity_list(entities: DataFrame, *, kind: str = "", name_contains: str = "", limit: int = 50) -> DataFrame:
    """Most recently updated entities per scope, one more than ``limit`` so the caller sees overflow."""
    rows = entities.filter(F.col("kind") != "self_model")
    if kind:
        rows = rows.filter(F.col("kind") == kind)
    if name_contains.strip():
        rows = rows.filter(F.contains(F.lower("name"), F.lit(name_contains.strip().lower())))
    return top_per_key(rows, SCOPE, [F.col("last_updated").desc(), F.col("name"), F.col("id")], limit + 1, "rank")


def entity_lookup(entities: DataFrame, lookups: DataFrame, *, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """Best matches per lookup: exact id, else same name, else name or id containing the text.

    ``lookups``: scope, lookup_id, wanted. Adds ``tier`` (1..3), ``rank`` and ``n_matches``, the
    matches of the chosen tier up to ``max_candidates``.
    """
    live = entities.filter(F.col("kind") != "self_model")
    q = lookups.select(*SCOPE, "lookup_id", X.strip(F.col("wanted")).alias("wanted")).filter(F.col("wanted") != "")
    cols = [*SCOPE, "lookup_id", "id"]
    exact = q.join(live.select(*SCOPE, "id"), (q.wanted == live.id) & (q.scope_kind == live.scope_kind) & (q.scope_owner == live.scope_owner))
    exact = exact.select(q.scope_kind, q.scope_owner, "lookup_id", live.id, F.lit(1).alias("tier"))
    low_names = live.select(*SCOPE, "id", F.lower("name").alias("_key"))
    same = q.withColumn("_key", F.lower("wanted")).join(low_names, [*SCOPE, "_key"]).select(*cols, F.lit(2).alias("tier"))
    # here the typed text is the needle, so lookups are the automaton and the entities the texts
    stack = live.select(*SCOPE, F.col("id").alias("text_id"), F.lower(F.concat_ws("\n", "name", "id")).alias("text"))
    needles = q.select(*SCOPE, F.col("lookup_id").alias("name_id"), F.lower("wanted").alias("name"))
    inside = names_in_texts(stack, needles).select(
        *SCOPE, F.col("name_id").alias("lookup_id"), F.col("text_id").alias("id"), F.lit(3).alias("tier")
    )
    hits = exact.select(*cols, "tier").unionByName(same).unionByName(inside).groupBy(*cols).agg(F.min("tier").alias("tier"))
    best = hits.groupBy(*SCOPE, "lookup_id").agg(F.min("tier").alias("_best"))
    hits = hits.join(best, [*SCOPE, "lookup_id"]).filter("tier = _best").drop("_best")
    rows = hits.join(live.select(*SCOPE, "id", "kind", "name", "last_updated"), [*SCOPE, "id"])
    top = top_per_key(rows, [*SCOPE, "lookup_id"], [F.col("last_updated").desc(), F.col("id")], max_candidates, "rank")
    n = top.groupBy(*SCOPE, "lookup_id").agg(F.count(F.lit(1)).alias("n_matches"))
    return top.join(n, [*SCOPE, "lookup_id"])
