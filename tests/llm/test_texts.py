"""Tokenizing, packing, fingerprints and near copies against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from memspark.llm import bpe, packing, simhash, spotsigs
from memspark.llm.queries import QUERIES
from memspark.llm.wordchunks import ChunkCoder, Memory, chunks_of
from tests.conftest import SMALL

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "don't DON'T it'll'", "a<|endoftext|>b <|EndOfText|> <|startoftext|>", "ΑΣ Σ İx ǅ ﬁ é Å ẞ", "a\x1cb\x85c\xa0d\u2003e", "👍🏽한日本²1", "ha" * 3000, "!?" * 200, "the the the", "x y"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def documents(spark, path, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, fp string").write.parquet(f"{path}/documents.parquet")
    return dict(enumerate(texts))


def test_words_match_the_library(library):
    own = bpe.PrefixBpe(PATH)
    rnd = random.Random(5)
    parts = ["a", "e", "s", "th", "ing", "é", "Σ", "'s", "'", "1", "²", "<|endoftext|>", "<|", "!", "\x1c", "\x85", " ", "\n", "İ", "́", "한", "👍", "TH", "\x00", "ß"]
    for _ in range(4000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert [i for c in chunks_of(text) for i in own.encode_chunk(c)] == library.encode(text, add_special_tokens=False).ids, text
    for _ in range(4000):
        word = "".join(rnd.choice("aeinorstlh") for _ in range(rnd.randint(1, 40)))
        assert own.encode_word(word) == library.encode(word, add_special_tokens=False).ids, word


def test_memory_forgets_but_stays_right():
    calls = []
    memory = Memory(lambda k: calls.append(k) or k.upper(), entries=3)
    assert [memory[k] for k in "abcabcdefabz"] == list("ABCABCDEFABZ") and len(memory) <= 3
    assert memory["y" * 500] == "Y" * 500 and "y" * 500 not in memory


def test_a_slice_has_every_word_encoded_once():
    asked = []

    def encode_words(words):
        asked.extend(words)
        return [np.array([ord(c) for c in w], "<u4").tobytes() for w in words]

    coder = ChunkCoder(encode_words, lambda t: b"", ["<s>"])
    texts = pa.array(["Ab ab, AB", None, "ab cd, " * 3, ""])
    want = [[ord(c) for c in t] for t in ("abab,ab", "", "abcd," * 3, "")]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)] == want and sorted(asked) == [",", "ab", "cd"]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)] == want and len(asked) == 3


def test_memory_in_bytes_turns_over():
    memory = Memory(None, entries=100, most_bytes=1000)
    for n in range(20):
        memory.keep_all({f"{n}_{i}": b"x" * 50 for i in range(5)})
    assert len(memory) + len(memory.old) <= 20 and "19_4" in memory


@pytest.mark.parametrize("texts", [None, ODD + ODD[3:5], []])
def test_encoding_and_packing_match_the_library(spark, tmp_path, library, texts):
    if texts is None:
        where, docs = SMALL, {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    else:
        where, docs = str(tmp_path), documents(spark, tmp_path, texts)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in docs.items()}
    rows = {r["doc_id"]: r for r in QUERIES["op4_prefix_bpe"](spark, where).collect()}
    assert rows.keys() == docs.keys()
    for i, found in ids.items():
        assert rows[i]["n_tokens"] == len(found) and rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(library.decode(found, skip_special_tokens=False).encode()).hexdigest()
    pieces = QUERIES["op6_pack_sequences"](spark, where).collect()
    check_pieces(pieces, {i: [*found, 2] for i, found in ids.items()}, 4096)


def check_pieces(pieces, ids, capacity, most_open=1):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids[i])
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[i][at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids[i])
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity


def test_packing_merges_leftovers_in_rounds(spark, library):
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice(["the", "of", "and"]) for _ in range(rnd.randint(0, 45))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(9)
    pieces = packing.pack_documents(docs, PATH, capacity=16, open_windows=3, group=2, with_ids=True).collect()
    check_pieces(pieces, {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}, 16)
    assert all(len(p["ids"]) == 4 * p["length"] for p in pieces)
    total = sum(p["length"] for p in pieces)
    assert len({p["sequence_id"] for p in pieces}) < 1.06 * total / 16


def test_best_fit_and_fullest_out():
    w = packing.OpenWindows(10, 2)
    assert [w.place(6, "a"), w.place(8, "b"), w.place(2, "c"), w.place(7, "d")] == [[], [], [["b", "c"]], []]
    assert w.place(5, "e") == [["d"]] and w.place(4, "f") == [["a", "f"]]


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=2):
    names = {i: i for i in fps}

    def top(x):
        while names[x] != x:
            x = names[x]
        return x

    order = sorted(fps)
    for a in order:
        for b in order:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                names[y] = x
    return {i: top(i) for i in fps}


@pytest.mark.parametrize("texts", [None, ODD + ["The  THE\tthe"], []])
def test_components_match_brute_force(spark, tmp_path, texts):
    if texts is None:
        where, docs = SMALL, {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    else:
        where, docs = str(tmp_path), documents(spark, tmp_path, texts)
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    named = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op8_simhash_bktree"](spark, where).collect()}
    assert got == {i: (f"{fps[i]:016x}", named[i]) for i in docs}


def test_tiny_trees_lose_no_link(spark):
    rnd = random.Random(4)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = [b ^ sum(1 << rnd.randrange(64) for _ in range(rnd.randint(0, 4))) for b in base for _ in range(40)]
    fps = [f & (1 << 64) - 1 for f in fps]
    rows = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    named = brute_components(dict(enumerate(fps)))
    for size in (3, 4096):
        found = {r["fp"]: r["component_id"] for r in simhash.fingerprint_components(rows, tree_size=size).collect()}
        assert {r["doc_id"]: found[r["fp"]] for r in rows.collect()} == named


def test_one_of_each_group_stays(spark):
    long = " ".join(f"word{i}" for i in range(400))
    rows = [(3, long, 1), (2, long + " x", 1), (2, long + " x", 1), (None, long, 1), (7, "quite another text here", 1), (None, "nobody knows this id", 1), (None, "nobody knows this id", 1), (9, None, 1), (8, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(2, long + " x"), (7, "quite another text here"), (None, "nobody knows this id"), (8, "")], key=str)


@pytest.mark.parametrize("texts", [None, ODD, ["only one here"], []])
def test_spotsigs_match_brute_force(spark, tmp_path, texts):
    if texts is None:
        where, docs = SMALL, {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    else:
        where, docs = str(tmp_path), documents(spark, tmp_path, texts)
    got = {r["doc_id"]: r for r in QUERIES["op7_spotsigs"](spark, where).collect()}
    assert got.keys() == docs.keys()
    ids = sorted(docs)
    sets = {i: set(spotsigs.spot_set(docs[i] or "").tolist()) for i in ids}
    for k, i in enumerate(ids):
        text, after = docs[i] or "", docs[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        near = set(spotsigs.spot_set(edited).tolist())
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(len(sets[i] & near) / len(sets[i] | near))
        following = sets[ids[(k + 1) % len(ids)]]
        assert r["near_next"] == pytest.approx(len(sets[i] & following) / len(sets[i] | following))
    by_text = {}
    for i in ids:
        assert by_text.setdefault(docs[i] or "", got[i]["fingerprint"]) == got[i]["fingerprint"]


def test_spots_follow_anchors():
    chained = spotsigs.spot_set("the quick brown fox")
    assert len(chained) == 1 and (chained == spotsigs.spot_set("The, quick (brown) dog!")).all()
    assert len(spotsigs.spot_set("the quick")) == 1 and len(spotsigs.spot_set("")) == 1
    a, b = np.arange(10, dtype=np.uint64), np.arange(5, 15, dtype=np.uint64)
    assert spotsigs.likeness(a, b) == pytest.approx(1 / 3) and spotsigs.likeness(a, b[:2], at_least=0.5) == 0.0


def test_spotsig_pairs_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sets = spotsigs.spot_signatures(docs).collect()
    own = {r["fingerprint"]: set(r["signatures"]) for r in sets}
    names = sorted(own)
    for at_least in (0.8, 0.5):
        want = {frozenset((a, b)) for k, a in enumerate(names) for b in names[k + 1 :] if len(own[a] & own[b]) / len(own[a] | own[b]) >= at_least}
        found = spotsigs.spotsig_pairs(spark.createDataFrame(sets), at_least).collect()
        assert {frozenset((r["a"], r["b"])) for r in found} == want and len(found) == len(want)


def test_edited_copies_go_and_shared_passages_stay(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows, copies = [], 0
    passage = " ".join(word() for _ in range(60))
    for group in range(12):
        words = [word() for _ in range(300)]
        rows.append((100 * group, " ".join(words)))
        for n in range(1, 4):
            edited = list(words)
            for at in rnd.sample(range(300), 3):
                edited[at] = word()
            rows.append((100 * group + n, " ".join(edited)))
            copies += 1
        rows.append((100 * group + 50, " ".join([*(word() for _ in range(120)), passage, *(word() for _ in range(120))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept >= {i for i, _ in rows if i % 100 in (0, 50)}
    assert len(kept) == len(rows) - copies


def test_common_passages_alone_are_filed_as_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 2)
    texts = ["alpha beta gamma delta epsilon zeta eta"] * 3
    rows = simhash.edit_signatures(spark.createDataFrame([(i, f"{t}{'!' * i}") for i, t in enumerate(texts)], "doc_id long, text string"), ["doc_id"])
    assert simhash.edit_links(rows.cache()).count() >= 0


def test_sketches_estimate_likeness():
    a, b = np.arange(0, 1000, dtype=np.uint64) * np.uint64(7919), np.arange(100, 1100, dtype=np.uint64) * np.uint64(7919)
    assert simhash.sketch_likeness(a[:10], a[:10]) == 1.0 and simhash.sketch_likeness(a[:10], b[900:910]) == 0.0


def kept_by_brute_force(rows):
    """The smallest id of every group linked by op8's two bits or by a five-word Jaccard of 0.8 or more."""
    fps = [simhash.fingerprint(t) for _, t in rows]
    sets = [set(zip(*(t.lower().split()[k:] for k in range(5)))) or {tuple(t.lower().split())} for _, t in rows]  # a short text is one shingle
    parts = simhash.Parts()
    for a in range(len(rows)):
        parts.top(a)
        for b in range(a):
            both = len(sets[a] & sets[b])
            if ((fps[a] ^ fps[b]) & simhash._ALL_BITS).bit_count() <= 2 or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                parts.join(a, b)
    groups = {}
    for n, (i, _) in enumerate(rows):
        groups.setdefault(parts.top(n), []).append(i)
    return {min(g) for g in groups.values()}


def edited_rows(rnd, ids, words, word, edits):
    out = []
    for i in ids:
        text = list(words)
        for at in rnd.sample(range(len(words)), edits):
            text[at] = word()
        out.append((i, " ".join(text)))
    return out


def test_large_groups_of_edited_copies_go(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", 16)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    # every copy has edits of its own, so most hashes of its sketch are common and some are rare
    rows = edited_rows(rnd, range(120), [word() for _ in range(300)], word, 3)
    assert kept_by_brute_force(rows) == {0}
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {0}


def test_texts_below_the_threshold_stay(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    passage, rows = [word() for _ in range(250)], []
    for i in range(20):  # likeness 0.71: unrelated text of their own around one long shared passage
        own = [word() for _ in range(48)]
        rows.append((i, " ".join([*own[:24], *passage, *own[24:]])))
    for group in range(8):  # likenesses on both sides of 0.8
        rows += edited_rows(rnd, range(100 + 10 * group, 106 + 10 * group), [word() for _ in range(300)], word, 2 + group)
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = kept_by_brute_force(rows)
    assert set(range(20)) <= want and {r["doc_id"] for r in kept.collect()} == want


def test_pipeline_stage_keeps_what_brute_force_keeps(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(150).collect()
    rnd, rows = random.Random(8), [(r["doc_id"], r["text"]) for r in given]
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    for i, text in rows[:40]:  # from light to heavy edits
        rows += edited_rows(rnd, [10**6 + i], text.split(), word, max(1, len(text.split()) * (i % 8) // 150))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, SMALL).collect()]
    want = kept_by_brute_force(rows)
    assert sorted(kept) == sorted(want) and 0 < len(rows) - len(want) and any(i >= 10**6 for i in want)
