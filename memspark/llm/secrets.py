"""Secret findings cleaned of false positives by a random forest.

Runs of key characters that could be credentials (12 or more in a word with a digit, or given to a credential name in
the word or the words before) are candidates, wherever in a word they stand: in urls, JSON or CSV without blanks.
So are the parts of such a run between ``/`` or ``@``, and values of 6 to 11 characters with a digit that are given to a
credential name. Each is described by its length, its character classes and the transitions between them, how far a dictionary of the corpus's most common words covers its letters, the path it was found
under and the words beside it. A random forest trained on labelled findings tells secrets from card numbers,
addresses, versions, links and the like. All is DataFrame work and the DataFrame-based forest of Spark.

Labelled findings may be handed in. Without them, candidates of well-known credential formats or given to
a credential name are labelled 1 and those of well-known harmless formats 0 (`label_of`); the rest have no
label and are for the forest to judge, which sees neither the formats nor the labels' rules. A few hundred made-up
findings are always added, so both classes exist in any table.

Edge cases: null and empty texts have no candidates; a null path is the empty path; repeated rows give their
findings each; an empty table gives no rows. Columns other than those named are ignored in findings and kept
as they are by ``redact``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.tables import first_by_hash, table
from memspark.session import materialize

#: Fewest characters of a candidate, and of one that is given to a credential name.
LEAST_CHARS, LEAST_GIVEN = 12, 6
#: Most common words of the corpus that make the dictionary, and the fewest letters of one.
DICTIONARY_WORDS, DICTIONARY_LETTERS = 2000, 3
#: Different labelled findings of each class the forest is fitted on, by hash order.
SAMPLE_ROWS = 4000
SEEDS = 300
TREES, DEPTH, SEED = 24, 7, 5
MASK = "[SECRET]"

_KEY_CHARS = "A-Za-z0-9+/_.@~-"
_CREDENTIAL = "pass(?:wor[dt]|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"
_HARMLESS = "card|phone|tel|fax|mail|visit|page|version|license|isbn|order|invoice|http|www|ip"
#: A value, and before it an optional name with = or :. The password of a url ends at its @.
_PASSWORD = r"(?<=://[^\s/@:]{0,64}:)[^\s/@]{%d,}(?=@)" % LEAST_CHARS
_NAMED = r"""(?<=(?<![A-Za-z0-9_-])-{0,2}([A-Za-z_][A-Za-z0-9_-]{0,40})["'`]?[=:]{1,3}["'`]?)"""
_VALUE = rf"(?<![{_KEY_CHARS}])(?=[{_KEY_CHARS}]{{{LEAST_CHARS}}})(?:{_NAMED}|)(?:{_PASSWORD}|[{_KEY_CHARS}]+)"
#: A short value given to a credential name in the same word.
_SHORT = rf"""(?i)({_CREDENTIAL})["'`]?[=:]{{1,3}}["'`]?(?=[A-Za-z+/_.@~-]*[0-9])([{_KEY_CHARS}]{{{LEAST_GIVEN},{LEAST_CHARS - 1}}})(?![{_KEY_CHARS}])"""
_ALONE = rf"""^["'`]?(?=[A-Za-z+/_.@~-]*[0-9])([{_KEY_CHARS}]{{{LEAST_GIVEN},{LEAST_CHARS - 1}}})["'`]?[,;.]?$"""
#: The words before a value that is given to a credential name: the name, or the name and a sign.
_GIVER, _SIGN = rf"""(?i)(?:{_CREDENTIAL})["'`)\]]*[=:]*["'`]*$""", r"^(?:=|:|:=|=>|==|->|is)$"
_MAYBE = rf"[0-9]|(?i:{_CREDENTIAL})"

#: Formats of credentials and of things that only look like them, for labels alone.
SECRET_FORMATS = [
    r"^AKIA[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36,}$", r"^sk-[A-Za-z0-9_-]{20,}$", r"^xox[abprs]-[A-Za-z0-9-]{10,}$", r"^AIza[0-9A-Za-z_-]{35}$",
    r"^eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{40,64}$",
]
HARMLESS_FORMATS = [
    r"^[0-9.+-]+$", r"@.+\.[a-z]{2,}$", r"^(?:[A-Za-z0-9-]+\.)+[a-z]{2,6}(?:/|$)", r"^/{1,2}[A-Za-z0-9._-]*(?:/|\.)", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"^v?[0-9]+(?:\.[0-9]+){1,3}", r"^[A-Za-z]+[-_.][A-Za-z]+[-_.]?[0-9]{0,4}$", r"^([A-Za-z0-9])\1+$", r"^[A-Z]?[a-z]+[0-9]{0,2}[.]?$",
]

FEATURES = [
    "f_length", "f_digits", "f_upper", "f_lower", "f_marks", "f_changes", "f_to_digit", "f_to_letter", "f_case", "f_distinct", "f_hex", "f_vowels", "f_covered",
    "f_run", "f_named", "f_quoted", "f_near_name", "f_near_harmless", "f_next_word", "f_path_depth", "f_path_doc", "f_slashes", "f_dots",
]


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The words that most documents hold, counted over all of them.

    A histogram of the counts, in steps of an eighth of a power of two, tells how common the last of them is;
    only words as common as that are ordered.
    """
    parts = F.split(F.lower("text"), r"[^\p{L}]+")
    each = docs.select(F.explode(F.array_distinct(F.filter(parts, lambda w: F.length(w) >= DICTIONARY_LETTERS))).alias("word"))
    counts = materialize(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "words")
    steps = counts.groupBy("step").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect()  # a few hundred rows at most
    least, held = 0, 0
    for r in steps:
        least, held = r["step"], held + r["n"]
        if held >= words:
            break
    return [r["word"] for r in counts.filter(F.col("step") >= least).orderBy(F.desc("n"), "word").limit(words).collect()]


def candidates(docs: DataFrame, keep: list[str], path: str = "source") -> DataFrame:
    """One row per candidate: the ``keep`` columns, path, position (word number), name, value and neighbours."""
    words = F.col("_words")

    def maybe(i: Column) -> Column:  # the cheap tests come first
        word = F.get(words, i)
        given = word.rlike(rf"(?i)(?:{_CREDENTIAL})[\"']?[=:]") | _given(F.get(words, i - 1), F.get(words, i - 2))
        long = (F.length(word) >= LEAST_CHARS) & (word.rlike("[0-9]") | F.coalesce(given, F.lit(False))) & word.rlike(rf"[{_KEY_CHARS}]{{{LEAST_CHARS}}}")
        return long | (word.rlike("[0-9]") & ((word.contains("=") | word.contains(":")) & word.rlike(_SHORT) | short(i)))

    def short(i: Column) -> Column:  # a short word after a credential name
        word = F.get(words, i)
        return (F.length(word) <= LEAST_CHARS + 2) & word.rlike(_ALONE) & F.coalesce(_given(F.get(words, i - 1), F.get(words, i - 2)), F.lit(False))

    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), maybe)
    near = F.transform(at, lambda i: F.struct(
        i.alias("position"), F.get(words, i).alias("word"), F.get(words, i - 1).alias("before"), F.get(words, i - 2).alias("before2"), F.get(words, i + 1).alias("after")
    ))
    rows = docs.filter(F.col("text").rlike(_MAYBE)).select(*keep, F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"), F.split("text", r"\s+").alias("_words"))
    rows = rows.select(*keep, "path", F.explode(near).alias("c")).select(*keep, "path", "c.*")

    def matches(pattern: str, value: int, name: int) -> Column:
        each = [F.regexp_extract_all("word", F.lit(pattern), F.lit(k)) for k in (value, name)]
        return F.zip_with(*each, lambda v, n: F.struct(n.alias("name"), v.alias("value"), F.lit(False).alias("short")))

    short_word = F.when(
        F.col("word").rlike(_ALONE) & F.coalesce(_given(F.col("before"), F.col("before2")), F.lit(False)),
        F.array(F.struct(F.lit("").alias("name"), F.regexp_extract("word", _ALONE, 1).alias("value"), F.lit(True).alias("short"))),
    )
    given = F.when(F.col("word").contains("=") | F.col("word").contains(":"), F.transform(matches(_SHORT, 2, 1), lambda v: v.withField("short", F.lit(True))))
    none = F.array().cast("array<struct<name: string, value: string, short: boolean>>")

    def trimmed(v: Column) -> Column:
        return v.withField("value", F.regexp_replace(v["value"], r"[.~]+$", ""))

    def segments(v: Column) -> Column:  # the parts of a path count as well
        parts = F.filter(F.split(v["value"], "[/@]"), lambda x: (F.length(x) >= LEAST_CHARS) & (x.rlike("[0-9]") | _any_of(x, SECRET_FORMATS)) & (x != v["value"]))
        return F.concat(F.array(v), F.when(v["value"].rlike("[/@]"), F.transform(parts, lambda x: v.withField("value", x))).otherwise(none))

    found = F.concat(F.flatten(F.transform(F.transform(matches(_VALUE, 0, 1), trimmed), segments)), F.transform(F.coalesce(given, none), trimmed), F.transform(F.coalesce(short_word, none), trimmed))
    # trailing marks may have been all there was
    found = F.array_distinct(F.filter(found, lambda v: F.length(v["value"]) >= F.when(v["short"], LEAST_GIVEN).otherwise(LEAST_CHARS)))
    rows = rows.withColumn("v", F.explode(found))
    return rows.select("*", F.col("v.name").alias("name"), F.col("v.value").alias("value")).drop("v")


def _any_of(value: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [value.rlike(p) for p in patterns])


def _given(before: Column, before2: Column) -> Column:
    """Whether the words before a value name a credential."""
    return before.rlike(_GIVER) | (before.rlike(_SIGN) & before2.rlike(_GIVER))


def _share(pattern: str) -> Column:
    """Share of the value's characters that match."""
    return F.try_divide(F.length("value") - F.length(F.regexp_replace("value", pattern, "")), F.length("value"))


def _pairs(first: str, second: str) -> Column:
    """Share of neighbouring characters of these classes."""
    return F.try_divide(F.regexp_count(F.col("value"), F.lit(f"(?<={first})(?={second})")), F.length("value"))


def describe(found: DataFrame, common: list[str]) -> DataFrame:
    """Add the ``FEATURES``."""
    value = F.col("value")
    classes = value
    for pattern, mark in (("[a-z]+", "a"), ("[A-Z]+", "B"), ("[0-9]+", "0"), ("[^aB0]+", "-")):
        classes = F.regexp_replace(classes, pattern, mark)
    runs = F.filter(F.split(F.lower(value), r"[^\p{L}]+"), lambda w: F.length(w) >= DICTIONARY_LETTERS)
    known = F.filter(runs, lambda w: w.isin(common)) if common else F.filter(runs, lambda w: F.lit(False))
    covered = F.aggregate(known, F.lit(0), lambda n, w: n + F.length(w))
    letters = F.aggregate(runs, F.lit(0), lambda n, w: n + F.length(w))
    beside = F.lower(F.concat_ws(" ", "before2", "before", "name"))
    flag = lambda c: c.cast("double")
    features = {
        "f_length": F.length(value), "f_digits": _share("[0-9]"), "f_upper": _share("[A-Z]"), "f_lower": _share("[a-z]"), "f_marks": _share("[^A-Za-z0-9]"),
        "f_changes": F.try_divide(F.length(classes) - 1, F.length(value)), "f_to_digit": _pairs("[A-Za-z]", "[0-9]"), "f_to_letter": _pairs("[0-9]", "[A-Za-z]"),
        "f_case": _pairs("[a-z]", "[A-Z]") + _pairs("[A-Z]", "[a-z]"), "f_distinct": F.try_divide(F.size(F.array_distinct(F.split(value, ""))), F.length(value)),
        "f_hex": flag(value.rlike("^[0-9a-f]+$")), "f_vowels": _share("[aeiouAEIOU]"), "f_covered": covered / F.greatest(letters, F.lit(1)),
        "f_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z]+"), 0), F.length)), F.lit(0)),
        "f_named": flag(F.col("name") != ""), "f_quoted": flag(F.col("word").rlike("[\"'`]")), "f_near_name": flag(beside.rlike(_CREDENTIAL)),
        "f_near_harmless": flag(beside.rlike(rf"\b(?:{_HARMLESS})")), "f_next_word": flag(F.coalesce(F.col("after").rlike(r"^\p{L}+[.,]?$"), F.lit(False))),
        "f_path_depth": F.length(F.regexp_replace("path", "[^/]", "")), "f_path_doc": flag(F.lower("path").rlike("test|example|sample|fixture|doc|readme")),
        "f_slashes": _share("/"), "f_dots": _share("[.]"),
    }
    return found.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in features.items()})


def label_of() -> Column:
    """1 for candidates of known credential formats, 0 for known harmless ones, else null."""
    value = F.col("value")

    given = F.lower("name").rlike(rf"^(?:{_CREDENTIAL})$") & value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    # a word of letters given to a credential name may be either
    open_ = F.coalesce((F.lower("name").rlike(rf"^(?:{_CREDENTIAL})$") | _given(F.col("before"), F.col("before2"))) & ~value.rlike("[0-9]"), F.lit(False))
    # a path or link with a key among its parts is not harmless as a whole
    holds_key = F.exists(F.split(value, "[/@]"), lambda part: _any_of(part, SECRET_FORMATS))
    return F.when(_any_of(value, SECRET_FORMATS) | given, 1).when(_any_of(value, HARMLESS_FORMATS) & ~open_ & ~holds_key, 0)


def seed_findings(spark: SparkSession, n: int = SEEDS) -> DataFrame:
    """Made-up labelled findings in the columns of ``candidates``: the usual formats, of hashed characters."""
    text = F.concat(*[F.md5(F.concat(F.lit(f"{i}-"), F.col("id").cast("string"))) for i in range(4)])
    base = F.translate(F.base64(F.unhex(text)), "+/=", "xyz")
    digits = F.regexp_replace(text, "[a-f]", "")
    k = F.col("id") % 6
    secret = (
        F.when(k == 0, F.concat(F.lit("AKIA"), F.upper(F.substring(base, 1, 16)))).when(k == 1, F.substring(text, 1, 40)).when(k == 2, F.substring(text, 3, 18))
        .when(k == 3, F.concat(F.lit("ghp_"), F.substring(base, 1, 36))).when(k == 4, F.substring(base, 5, 32)).otherwise(F.concat(F.lit("sk-"), F.substring(base, 9, 24)))
    )
    name = F.when(k == 2, "password").when(k == 4, "api_key").otherwise("")
    part = F.concat(F.lit("mail"), F.substring(digits, 1, 1), F.lit(".example.com"))
    harmless = (
        F.when(k == 0, F.substring(digits, 1, 16)).when(k == 1, F.regexp_replace(F.substring(digits, 1, 12), r"([0-9]{3})(?=[0-9])", "$1.")).when(k == 2, part)
        .when(k == 3, F.concat(F.lit("user."), F.substring(digits, 1, 2), F.lit("@"), part)).when(k == 4, F.concat(F.lit("//www.example.org/page/"), F.substring(digits, 1, 5)))
        .otherwise(F.concat(F.lit("2024-0"), (F.col("id") % 9 + 1).cast("string"), F.lit("-1"), (F.col("id") % 10).cast("string"), F.lit("T12:00")))
    )
    rows = spark.range(n)
    good = rows.select(secret.alias("value"), name.alias("name"), F.when(k == 1, "=").otherwise("the").alias("before"), F.when(k == 1, "token").otherwise("of").alias("before2"), F.lit(1).alias("label"))
    bad = rows.select(harmless.alias("value"), F.when(k == 4, "https").otherwise("").alias("name"), F.lit("the").alias("before"), F.lit("of").alias("before2"), F.lit(0).alias("label"))
    word = F.when(F.col("name") != "", F.concat("name", F.lit("="), "value")).when((F.col("label") == 1) & F.col("value").rlike("^[0-9a-f]{40}$"), F.concat(F.lit('"'), "value", F.lit('"'))).otherwise(F.col("value"))
    return good.unionByName(bad).select(F.lit("").alias("path"), F.lit(0).alias("position"), word.alias("word"), "before", "before2", F.lit("and").alias("after"), "name", "value", "label")


def fit_forest(labelled: DataFrame, seeds: DataFrame, rows: int = SAMPLE_ROWS):
    """A forest from findings with ``FEATURES`` and ``label``: all ``seeds`` and at most ``rows`` others of each class, by
    hash order; copies of a finding count once."""
    key = F.md5(F.to_json(F.struct("path", "word", "before", "before2", "after", "name", "value"))).alias("_key")
    named = [*FEATURES, F.col("label").cast("double").alias("label")]
    known = materialize(labelled.filter(F.col("label").isin(0, 1)).select(*named, key).dropDuplicates(["_key", "label"]), "labelled")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    parts = [first_by_hash(known.filter(F.col("label") == label), F.col("_key"), rows, n).drop("_key") for label, n in sorted(counts.items())]
    sample = materialize(reduce(DataFrame.unionByName, [*parts, seeds.select(*named)]).coalesce(1), "findings")  # a fixed order of rows makes the forest repeatable
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="features", labelCol="label", featureSubsetStrategy="sqrt")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(sample)


def find_secrets(docs: DataFrame, keep: list[str], path: str = "source", labelled: DataFrame | None = None) -> DataFrame:
    """All candidates of whole texts with ``score`` (of being a secret) and ``is_secret``.

    ``labelled``: findings in the columns of ``candidates`` with ``label``; by default those the formats tell.
    """
    common = dictionary(docs)
    found = materialize(describe(candidates(docs, keep, path), common), "candidates")
    base = ["path", "position", "word", "before", "before2", "after", "name", "value"]
    if labelled is None:
        labelled = found.withColumn("label", label_of()).filter("label is not null").select(*base, "label", *FEATURES)
    else:
        labelled = describe(labelled, common).select(*base, "label", *FEATURES)
    seeds = describe(seed_findings(docs.sparkSession), common).select(*base, "label", *FEATURES)
    model = fit_forest(labelled, seeds)
    scored = model.transform(found).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.select(*keep, "path", "position", "name", "value", "score", (F.col("score") >= 0.5).alias("is_secret"))


def redact(docs: DataFrame, path: str = "source") -> DataFrame:
    """``docs`` with every secret's value in its text replaced by ``MASK``; other rows and columns stay."""
    columns = docs.columns
    keyed = docs.select(F.struct(*columns).alias("row"), "doc_id", "text", F.col(path).alias("_path"), F.xxhash64("text").alias("_key"))
    hit = F.coalesce(F.col("text").rlike(_MAYBE), F.lit(False))
    found = find_secrets(keyed, ["doc_id", "_key"], "_path").filter("is_secret").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_of"), "value")
    per_text = found.groupBy("_id", "_of").agg(F.collect_set("value").alias("_values"))
    longest = F.array_sort(F.col("_values"), lambda a, b: F.length(b) - F.length(a))
    clean = F.aggregate(F.coalesce(longest, F.array().cast("array<string>")), F.col("row.text"), lambda t, v: F.replace(t, v, F.lit(MASK)))
    joined = keyed.filter(hit).join(per_text, keyed["doc_id"].eqNullSafe(per_text["_id"]) & (keyed["_key"] == per_text["_of"]), "left")
    cleaned = joined.select(F.col("row").withField("text", clean).alias("row"))
    return keyed.filter(~hit).select("row").unionByName(cleaned).select("row.*")


def op5_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in every document, by digest, with the forest's verdict."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    found = find_secrets(docs, ["doc_id"])
    return found.select("doc_id", "position", F.sha2("value", 256).alias("value_sha256"), F.length("value").alias("length"), "score", "is_secret")
