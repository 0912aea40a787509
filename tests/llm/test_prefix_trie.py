"""The conversations' trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tessera.llm import prefix_trie
from tessera.llm.common import read_table
from tessera.llm.queries import LLM_QUERIES

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, pid string, depth string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            first = int(digest[:16], 16)
            own[c].append(((turn is not None, turn or 0, role.encode(), first - (first >> 63 << 64)), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(map(str, ((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p],
                             hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p in members)))


def result(df):
    return sorted(str(tuple(r)) for r in df.select(*COLUMNS).collect())


def corpus(n=260):
    rnd = random.Random(2)
    roles, rows = ["user", "assistant", None, "ü"], []
    say = lambda: rnd.choice(["hi", "hello \U0001f600", "", None, "ok " * 30, "中文", str(rnd.randrange(40))])
    for c in [*range(n), 500, 777, 900, 901, 1 << 40, -7, -205]:
        k = rnd.choice([0, 1, 2, 3, 5, 8, 14])
        if c % 7 == 0:
            rows += [(c, t, "user", "same") for t in range(6)]
        else:
            turns = rnd.sample(range(100), k) if rnd.random() < 0.8 else [rnd.choice([None, 1, 1, 2]) for _ in range(k)]
            rows += [(c, t, rnd.choice(roles), say()) for t in turns]
    rows += [(900, t, "user", "long") for t in range(300)] + [(901, t, "user", "long") for t in range(290)]
    rows += [(None, 1, "user", "nobody"), (None, None, None, None), (333, None, None, None), (700, 5, "r", "x" * 200_000)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [{}, {"SHARD_TURNS": 4, "QUEUE": 2, "CHUNK": 2}])
def test_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():           # several levels of shards, spilled queues, chunked ids
        monkeypatch.setattr(prefix_trie, name, value)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    assert result(prefix_trie.prefix_trie(df)) == brute(rows)


def test_long_conversations_span_partitions(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(c, t, "user", f"{t % 9} {c % 2}") for c in (0, 2, 4) for t in range(4000)] + [(6, t, "u", "z") for t in range(3)]
        assert result(prefix_trie.prefix_trie(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_whole_table_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert result(LLM_QUERIES["op11_prefix_trie"](spark, sf)) == brute(rows)


def test_empty_table_and_queue(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    rnd = random.Random(1)
    queue, kept = prefix_trie.SpillingQueue(10, 2, 3), []
    for _ in range(2000):
        if kept and rnd.random() < 0.45:
            assert queue.head() == min(kept)
            kept.remove(queue.pop())
        else:
            kept.append((rnd.randrange(50), rnd.randrange(1 << 60)))
            queue.push(kept[-1])
    assert [queue.pop() for _ in range(len(kept))] == sorted(kept) and queue.head() is None and queue.made > 5
