"""WARC archives, sharding and URL rules against brute force, with nulls, ties and clashing columns."""

import hashlib
import io
import math
import zlib

import pytest
from pyspark.sql import functions as F

from memspark.llm import sharding, urlrules, warc
from memspark.llm.queries import QUERIES
from tests.conftest import SMALL

BIG, SMALL_HTML = "é" * 600, "x" * 999
PAGES = [
    (1, "http://a/", BIG, 7), (2, "http://b/", BIG, 7), (3, None, BIG, 7), (4, "http://c/ d\r\ne", SMALL_HTML, 7), (5, "http://c/", SMALL_HTML, 7), (6, "u", None, 7), (7, "u", "", 7),
    (8, "http://x/", "line\r\n\r\nWARC/1.1\r\n" + BIG + "1", 7), (None, "http://n/", BIG, 7), (9, "http://y/", BIG + "2", 7), (9, "http://y/", BIG + "2", 7), (10, "z", "\x00" * 70_000, 7),
]


def write_pages(spark, path, rows):
    spark.createDataFrame(rows, "page_id long, url string, html string, copies int").write.parquet(f"{path}/pages.parquet")


def test_transactions_match_brute_force(spark, tmp_path):
    write_pages(spark, tmp_path, PAGES)
    got = sorted((r[:5] for r in map(tuple, warc.op1_warc_transactions(spark, str(tmp_path)).collect())), key=str)
    want = []
    for page_id, _, html, _ in PAGES:
        raw = (html or "").encode()
        owner = max((p for p, _, h, _ in PAGES if (h or "").encode() == raw and p is not None), default=None)
        revisit = len(raw) >= 1000 and owner != page_id
        want.append((page_id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", owner if revisit else None))
    assert got == sorted(want, key=str)


def test_no_pages(spark, tmp_path):
    write_pages(spark, tmp_path, [])
    assert warc.op1_warc_transactions(spark, str(tmp_path)).collect() == []


def test_nested_capture_keeps_payload(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string, copies int")
    warc.write_warc(warc.capture_records(warc.plan_captures(pages)), f"{tmp_path}/w")
    rows = warc.assemble(warc.read_warc(spark, f"{tmp_path}/w")).collect()
    assert len(rows) == len(PAGES) - 1 and sum(r["copies"] for r in rows) == len(PAGES)
    for r in rows:
        assert r["request"]["warc_type"] == "request" and len(r["metadata"]) == 1
        if r["response"]["warc_type"] == "response":
            assert hashlib.sha1(r["response"]["payload"]).hexdigest() == r["response"]["declared_digest"]
    assert {r["response"]["target_uri"] for r in rows} >= {"http://c/%20d%20%20e", None}


def test_broken_archives_are_refused():
    for text in (b"HTTP/1.1\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"WARC/1.1\r\nContent-Type: x\r\n"):
        with pytest.raises((ValueError, KeyError)):
            list(warc.parse_records(io.BytesIO(text)))


def shard_of(key, n):
    def cost(i):
        return -math.log((int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13)

    return min(range(n), key=lambda i: (cost(i), i))


def test_shards_match_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op2_rendezvous_shards"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    slots = {}
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert (r["shard"], r["grown_shard"]) == (shard_of(r["doc_id"], 40), shard_of(r["doc_id"], 41))
        assert r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(spark, tmp_path):
    rows = [(None, None, 1), (None, "a", 1), (5, "", 1), (5, "", 1), (5, "é" * 50_000, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, slot int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op2_rendezvous_shards(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted((d or 0, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for d, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sharding.op2_rendezvous_shards(spark, f"{tmp_path}/none").count() == 0


def test_weights_share_keys(spark):
    rows = sharding.rendezvous_shards(spark.range(4000), F.col("id"), [1.0, 3.0]).groupBy("shard").count().collect()
    heavy = {r["shard"]: r["count"] for r in rows}[1]
    assert abs(heavy / 4000 - 0.75) < 0.03
    with pytest.raises(ValueError):
        sharding.shard_costs(F.col("id"), [1.0, 0.0])


URLS = [
    "https://WWW.Example.ORG/es/1?x", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "http://a.com/de/x#f", "http://a.com/fr/", "http://com/de/", "http://x.com?/de/",
    "org/", "http://org/", "http://org", None, "", "a://b://c/d", "http://É.com/fr/q", "http://example.org:80/es/", "http://example.org/es", "http://a.net/de/", "HTTP://ORG.com/de/" + "y" * 50_000,
]


def brute_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in urlrules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules_match_brute_force(spark, tmp_path):
    rows = [(i % 17, u, "h", "clash") for i, u in enumerate(URLS + URLS[:3])]
    spark.createDataFrame(rows, "page_id long, url string, html string, rule string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in urlrules.op10_url_rules(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, *brute_verdict(u)) for i, u, _, _ in rows), key=str)


def test_rule_without_token_is_still_tried(spark):
    urls = spark.createDataFrame([("a.b", "/x"), ("c", "/y")], "host string, path string")
    rules = spark.createDataFrame([("b", "", "block"), ("b", "/x", "allow"), ("b", "/x", "allow")], "host string, path string, verdict string")
    got = {r["host"]: (r["rule"], r["verdict"]) for r in urlrules.judge_urls(urls, rules, "keep").collect()}
    assert got == {"a.b": ("b/x", "allow"), "c": (None, "keep")}
