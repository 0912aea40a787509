"""WARC round trips and the hash tree, against plain Python."""

import base64
import gzip
import hashlib
import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from tessera.llm import sharding, warc
from tessera.llm.queries import LLM_QUERIES

SF = "/root/testdata/sf0.001"


def b32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


PAGES = [(1, "<p>a</p>", "http://x/1"), (2, "<p>a</p>", None), (7, "<p>a</p>", "u\r\nv"), (3, "", "x"), (4, None, "x"),
         (5, "é" * 70_000, "x"), (6, "one\r\n\r\nWARC/1.1\r\n\r\ntwo", "x"), (7, "<p>a</p>", "again"), (None, "<p>a</p>", "n")]


def test_round_trip_against_plain_python(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, html string, url string").withColumn("sha1", F.lit("clash"))
    out = warc.archive_round_trip(df, folder=f"file://{tmp_path}/w", chunk_bytes=1000, segment_bytes=50)
    got = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0)
                 for r in out.collect())
    groups = defaultdict(list)
    for i, h, _ in PAGES:
        groups[h or ""].append(i)
    want = []
    for i, h, _ in PAGES:
        b = (h or "").encode()
        top = max(x for x in groups[h or ""] if x is not None)
        own = i is None or i == top
        want.append((-1 if i is None else i, len(b), b32(b), "response" if own else "revisit", 0 if own else top))
    assert got == sorted(want)
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in Path(f"{tmp_path}/w").glob("*.warc.gz"))
    assert raw.count(b"WARC-Type: response") == 6 and raw.count("é".encode()) == 70_000


def test_chunk_rows_carry_running_digests(spark, tmp_path):
    df = spark.createDataFrame([(5, "abc" * 1000, "x")], "page_id long, html string, url string")
    folder = f"file://{tmp_path}/c"
    manifest = warc.write_archives(warc.chunked(warc.with_responses(df, "page_id", "html", "url", 0), 700), folder, 1 << 20)
    rows = sorted(warc.read_archives(manifest, folder, 700).collect(), key=lambda r: r.chunk_no)
    body = b""
    for r in rows:
        assert len(r.chunk) <= 700
        body += bytes(r.chunk)
        assert r.bytes_so_far == len(body) and r.sha1_so_far == b32(body)
    assert body == b"abc" * 1000 and [r.last for r in rows] == [False] * 4 + [True]


def test_small_payloads_below_the_bound_are_all_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "aa", "x"), (2, "aa", "x")], "page_id long, html string, url string")
    out = warc.archive_round_trip(df, folder=f"file://{tmp_path}/s", least_bytes=3).collect()
    assert {r.record_type for r in out} == {"response"}
    assert warc.archive_round_trip(df.limit(0), folder=f"file://{tmp_path}/e").count() == 0


def place(key, tree):
    def draw(name, w):
        u = (int(hashlib.md5(f"0/{name}/{key}".encode()).hexdigest()[:13], 16) + 1) / float(1 << 52)
        return math.log(u) / w

    def won(name, weights):
        d = [draw(f"{name}.{i}", w) for i, w in enumerate(weights)]
        return d.index(max(d))
    r = won("r", [sum(w for c in x for _, w in c) for x in tree.regions])
    c = won(f"r.{r}", [sum(w for _, w in x) for x in tree.regions[r]])
    return tree.regions[r][c][won(f"r.{r}.{c}", [w for _, w in tree.regions[r][c]])][0]


def test_sharding_query_against_plain_python(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = LLM_QUERIES["op9_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    tree = sharding.even_tree(40)
    by = defaultdict(list)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert r.shard == place(r.doc_id, tree) and r.grown_shard == place(r.doc_id, tree.with_region(40))
        assert r.grown_shard in (r.shard, 40)
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_tree_is_fair_and_moves_rows_only_into_the_changed_subtree(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    tree = sharding.Tree(((((0, 1.0), (1, 3.0)), ((2, 2.0),)), (((3, 2.0),),)))
    heavier = sharding.Tree((tree.regions[0], (((3, 4.0),),)))
    both = sharding.place(sharding.place(keys, F.col("k"), tree, "a"), F.col("k"), heavier, "b").collect()
    n = Counter(r.a for r in both)
    for shard, weight in {0: 1, 1: 3, 2: 2, 3: 2}.items():
        assert abs(n[shard] / 20_000 - weight / 8) < 0.015
    assert all(r.b in (r.a, 3) for r in both) and any(r.a != r.b for r in both)


def test_sharding_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "x", 2), (1, "x", 3)], "doc_id long, text string, shard int")
    rows = sharding.shard_documents(df).collect()
    assert len(rows) == 3 and {r.size for r in rows} == {16, 17}
    assert sorted(r.slot for r in rows if r.doc_id == 1) in ([0, 1], [1, 2])
    assert sharding.shard_documents(df.limit(0)).count() == 0
