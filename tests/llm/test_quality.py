"""The quality query against plain Python: every feature hashed by itself, every score and training step written out."""

import math

import numpy as np
import pytest

from memspark.llm import quality
from memspark.llm.queries import QUERIES
from tests.conftest import SMALL

WORD = (1 << 64) - 1
PAIR = int(quality._PAIR)


def row(hashed):
    return (hashed * PAIR & WORD) >> 40 & int(quality._MASK)


def plain_rows(text):
    """The table rows of a text, one feature at a time."""
    yield quality._END
    last = None
    for word in text.split():
        codes = [ord(c) for c in f"<{word}>"]
        for n in quality.NGRAMS:
            for i in range(len(codes) - n + 1):
                gram = codes[i]
                for code in codes[i + 1 : i + n]:
                    gram = (gram * PAIR + code) & WORD
                yield row(gram + n)
        name = 0
        for place, code in enumerate(codes):
            spread = (code + place * 0x10FFFF) * PAIR & WORD
            name += (spread ^ spread >> 31) * PAIR
        name &= WORD
        yield name >> 40 & int(quality._MASK)
        if last is not None:
            yield quality._SAME if last == name else row((last * PAIR & WORD) ^ name)
        last = name


def plain_score(model, text):
    rows = list(plain_rows(text))
    x = sum(float(model.odds[r]) for r in rows) / len(rows) + model.bias
    return 1 / (1 + math.exp(-x))


@pytest.mark.parametrize("text", ["", "a", "ab ab  c", "Größe 𝒳 \t wörter wörter\n und mehr", "x" * 500 + " y"])
def test_rows_are_those_hashed_one_by_one(text):
    assert sorted(np.concatenate(list(quality.text_rows(text))).tolist()) == sorted(int(r) for r in plain_rows(text))


def test_every_score_of_the_query_is_the_plain_one(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in QUERIES["op3_quality"](spark, SMALL).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = plain_score(model, text)
        assert got[i][0] == pytest.approx(want, abs=1e-9)
        assert got[i][1] == int(got[i][0] >= 0.5)


def test_the_stage_keeps_what_the_plain_score_accepts(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    want = sorted(r["doc_id"] for r in docs.select("doc_id", "text").collect() if plain_score(model, r["text"] or "") >= 0.5)
    assert sorted(r["doc_id"] for r in quality.keep_good(docs, labels).select("doc_id").collect()) == want


def test_training_follows_the_written_out_steps():
    """Softmax loss, gradients by hand, one document a step, classes weighted to equal shares."""
    texts, labels = ["calm plain words", "BUY now now", "other calm line", "win BUY win"], [1, 0, 1, 0]
    epochs, rate, seed = 3, 0.5, 7
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (quality.BUCKETS, quality.DIMENSIONS)) / quality.DIMENSIONS
    weights, bias = np.zeros((2, quality.DIMENSIONS)), [0.0, 0.0]
    step, steps = 0, epochs * len(texts)
    for _ in range(epochs):
        for k in rng.permutation(len(texts)):
            rows = list(plain_rows(texts[k]))
            mean = sum(vectors[r] for r in rows) / len(rows)
            odds = [math.exp(float(weights[c] @ mean) + bias[c]) for c in (0, 1)]
            pull = [(odds[c] / sum(odds) - (labels[k] == c)) * rate * (1 - step / steps) / (2 * 0.5) for c in (0, 1)]
            back = pull[0] * weights[0] + pull[1] * weights[1]
            for c in (0, 1):
                weights[c] = weights[c] - pull[c] * mean
                bias[c] -= pull[c]
            for r in set(rows):
                vectors[r] = vectors[r] - math.sqrt(rows.count(r) / len(rows)) * back
            step += 1
    model = quality.train(texts, labels, epochs=epochs, rate=rate, seed=seed)
    assert model.bias == pytest.approx(bias[1] - bias[0], abs=1e-5)
    assert np.allclose(model.odds, vectors @ (weights[1] - weights[0]), atol=1e-5)
