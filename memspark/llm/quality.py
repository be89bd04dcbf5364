"""Text quality from supervised subword embeddings.

Every word, its character n-grams, every pair of neighbouring words and the fact that a word repeats the one
before it are hashed to rows of one table of learned vectors. A document is the average of its rows; a
softmax over the classes reads it. Both are learned by stochastic gradient descent in numpy on a bounded
sample of labelled rows. Because average and output are linear, a row counts through one number, its
vector's part in the log odds; scoring sums these numbers over whole texts.

Edge cases: a null text is empty; an empty text has the end mark as its only feature and so a score of its
own; labels other than 0 and 1 and rows without id are not used; a document labelled twice counts twice;
without rows of both classes every score is 0.5 (predicted 1). Repeated rows are scored each; an empty
table gives no rows. Columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.tables import first_by_hash, table
from memspark.llm.wordchunks import chunks_of, forget_all

#: Rows of the vector table, and the length of a vector.
BUCKETS, DIMENSIONS = 1 << 16, 12
NGRAMS = (2, 3, 4)
#: The sample for fitting: so many rows of each class, by hash order, of at most so many bytes together.
SAMPLE_ROWS, SAMPLE_BYTES = 1500, 24_000_000
EPOCHS, RATE, SEED = 4, 0.5, 7
_MASK = np.uint64(BUCKETS - 1)
#: Two rows of their own: the end of a text, and a word that repeats the one before.
_END, _SAME = 0, 1
#: Characters of words handled at once; a longer word counts as several.
SEGMENT_CHARS = 1 << 18
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def segments(text: str) -> Iterator[list[str]]:
    """A text's words, so many at a time that their arrays stay small; huge words come in pieces."""
    part, held = [], 0
    for chunk in chunks_of(text):
        pieces = [chunk[i : i + SEGMENT_CHARS] for i in range(0, len(chunk), SEGMENT_CHARS)] if len(chunk) > SEGMENT_CHARS else (chunk,)
        for piece in pieces:
            if held + len(piece) > SEGMENT_CHARS and part:
                yield part
                part, held = [], 0
            part.append(piece)
            held += len(piece) + 2
    if part:
        yield part


def text_rows(text: str) -> Iterator[np.ndarray]:
    """The table rows of a text, repeats included, in a few arrays.

    All words are laid side by side with marked ends; n-grams are hashed at every position and those that
    would reach into the next word left out.
    """
    last = None
    yield np.array([_END])
    for words in segments(text):
        codes = np.frombuffer(f"<{'><'.join(words)}>".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        starts = np.cumsum(lengths) - lengths
        word = np.repeat(np.arange(len(words)), lengths)
        gram = codes
        for n in range(2, max(NGRAMS) + 1):
            gram = gram[:-1] * _PAIR + codes[n - 1 :]
            if n in NGRAMS:
                inside = word[: len(gram)] == word[n - 1 :]
                yield (((gram + np.uint64(n)) * _PAIR >> np.uint64(40)) & _MASK).astype(np.int64)[inside]
        place = (np.arange(len(codes)) - starts[word]).astype(np.uint64)
        spread = (codes + place * np.uint64(0x10FFFF)) * _PAIR
        ids = np.add.reduceat((spread ^ spread >> np.uint64(31)) * _PAIR, starts)
        yield (ids >> np.uint64(40) & _MASK).astype(np.int64)
        before = ids[:-1] if last is None else np.concatenate([[last], ids[:-1]])
        after = ids[1:] if last is None else ids
        mixed = (before * _PAIR ^ after) * _PAIR >> np.uint64(40)
        yield np.where(before == after, _SAME, (mixed & _MASK).astype(np.int64))
        last = ids[-1]


@dataclass
class Model:
    """``odds``: each row's part in the log odds of class 1; ``bias``: what is common to all texts."""

    odds: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        total = n = 0
        for rows in text_rows(text):
            total += float(self.odds[rows].sum())
            n += len(rows)
        return float(1 / (1 + np.exp(-np.clip(total / n + self.bias, -60, 60))))


def train(texts: list[str], labels: list[int], *, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Vectors, softmax weights and biases by stochastic gradient descent, one document a step."""
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS), 0.0)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    weights, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    docs = []
    for text in texts:
        counts = sum(np.bincount(rows, minlength=BUCKETS) for rows in text_rows(text))
        rows = np.flatnonzero(counts)
        docs.append((rows.astype(np.int32), (counts[rows] / counts.sum()).astype(np.float32)))
    share = np.bincount(labels, minlength=2) / len(labels)
    step, steps = 0, epochs * len(docs)
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            rows, part = docs[k]
            mean = part @ vectors[rows]
            logits = weights @ mean + bias
            out = np.exp(logits - logits.max())
            error = out / out.sum()
            error[labels[k]] -= 1
            error *= rate * (1 - step / steps) / (2 * share[labels[k]])
            back = weights.T @ error
            weights -= np.outer(error, mean)
            bias -= error
            # the step of a row grows with the root of its share, so frequent rows do not drown the rare
            vectors[rows] -= np.sqrt(part)[:, None] * back
            step += 1
    return Model(vectors @ (weights[1] - weights[0]), float(bias[1] - bias[0]))


def held_out(doc_id):
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from at most ``rows`` labelled rows of each class outside the held-out third.

    First only ids and sizes come, in hash order; then the texts of as many of them as ``most_bytes`` allow.
    """
    marked = labels.select(F.col("doc_id").alias("_id"), "quality").filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
    key = F.concat(F.lit("sample"), F.col("_id").cast("string"))
    parts = [first_by_hash(marked.filter(F.col("quality") == label), key, rows, n) for label, n in sorted(counts.items())]
    if len(parts) < 2:
        return Model(np.zeros(BUCKETS), 0.0)
    chosen = parts[0].unionByName(parts[1]).withColumn("_order", F.md5(key))
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    light = texts.select("_id", F.octet_length("text").alias("_size"))
    sized = light.join(F.broadcast(chosen), "_id").orderBy("_order", "_id").limit(2 * rows).collect()  # 2 * rows ids at most
    taken, room = [], most_bytes
    for r in sized:
        if r["_size"] <= room:
            room -= r["_size"]
            taken.append((r["_id"], r["quality"]))
    if not taken:
        return Model(np.zeros(BUCKETS), 0.0)
    spark = docs.sparkSession
    wanted = spark.createDataFrame(sorted(set(taken)), "_id long, quality int")
    got = texts.join(F.broadcast(wanted), "_id").select("_id", "text", "quality").toArrow().sort_by([("_id", "ascending"), ("quality", "ascending"), ("text", "ascending")])
    return train(got.column("text").to_pylist(), got.column("quality").to_pylist())


def score_texts(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``score`` of every row."""
    types = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # half a megabyte, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_all()
        score = shared.value.score
        for batch in batches:
            scores = pa.array([score(t.as_py() or "") for t in batch.column(0)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], scores], names=[*keep, "score"])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in keep], "score double"])
    return docs.select(F.col(text_col), *keep).mapInArrow(run, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_texts(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier accepts, unchanged."""
    columns = docs.columns
    model = fit(docs, labels)
    keyed = docs.select(F.struct(*columns).alias("row"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scores = _score_column(shared)
    return keyed.withColumn("score", scores("text")).filter(F.col("score") >= 0.5).select("row.*")


def _score_column(shared):
    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget_all()
        score = shared.value.score
        for texts in batches:
            yield pa.array([score(t.as_py() or "") for t in texts], pa.float64())

    return scores
