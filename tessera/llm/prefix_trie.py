"""The prefix trie of conversations, its subtree totals by time-forward
processing.

1. Turns are range-sorted by conversation and turn, so a long conversation is
   spread over tasks; positions are counted in each and the few conversations
   that go on in a next task are offset by a small table.
2. Each conversation is rebuilt from the first turns of its group's base and
   its own.  A prefix is known by the exclusive-or of a 128-bit hash of every
   turn with its place, which again is summed up in sorted order; equal
   prefixes are one node by a grouped minimum, count and sum.
3. Nodes of one conversation alone need no sums.  Of the others those whose
   subtrees hold at most SHARD_TURNS turns form the shards: a subtree goes to
   one task as a whole, its nodes externally sorted by reverse level order.  A
   node takes the totals of its children from a priority queue, which spills
   to a file beyond QUEUE entries, and sends its own to its parent.  The
   roots of these subtrees send their totals to the nodes above by a grouped
   sum; these form the next, wider shards, and so on up to the root.
4. Ids of conversations that end at a node are range-sorted, joined in chunks
   and hashed chunk by chunk.  (A digest over ids in order is sequential by its
   definition: of a node that a third of all conversations end at, one task
   reads the chunks, in constant memory.)

Defined results: a null role or text is empty; turns with a null number come
first; turns of one number stand in the order of role and the text's digest;
repeated turns all count.  Rows without a conv_id belong to no conversation.
The base of c is c - c % 100 with the remainder's sign as in SQL.  Conversations
that lose all turns are members of the root only.  An empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, text_or_empty

GROUP, HEADS = 100, 6              # conversations that share a base; shared turns are fewer than HEADS
SHARD_TURNS = 1 << 16
QUEUE = 1 << 18
CHUNK = 1 << 16                    # ids of one chunk

_KEY = ["depth", "k1", "k2"]
_MIX = [np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)]
_STEP = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], list(columns))


def _sorted(rows: DataFrame, *order) -> DataFrame:
    """``rows`` range-sorted, pid telling the order of the partitions."""
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())


def _within(conv: np.ndarray, values: list[np.ndarray], held) -> tuple[list[np.ndarray], tuple]:
    """Exclusive-or of each value and those before it in its conversation, in
    a batch sorted by conversation; ``held`` is what the batch before left."""
    starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    sizes = np.diff(np.append(starts, len(conv)))
    out = []
    for k, v in enumerate(values):
        run = np.bitwise_xor.accumulate(v)
        run ^= np.repeat(np.append(np.zeros(1, dtype=v.dtype), run[starts[1:] - 1]), sizes)
        if held and held[0] == conv[0]:
            run[:sizes[0]] ^= held[1][k]
        out.append(run)
    return out, (conv[-1], [r[-1] for r in out])


def positions(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, d1, d2, len): every turn with its place from 0, 128 bits
    of the digest of role and text, and the text's code points."""
    role, text = text_or_empty("role"), text_or_empty("text")
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    lane = lambda k: F.conv(F.substring("digest", 1 + 16 * k, 16), 16, -10).cast("long")
    rows = (conversations.filter("conv_id is not null")
            .select(F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"),
                    F.length(text).cast("long").alias("len"), F.monotonically_increasing_id().alias("row"))
            .select("conv_id", "turn", "role", lane(0).alias("d1"), lane(1).alias("d2"), "len", "row"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "d1", "row"]

    def run(batches):
        last, done = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column("conv_id").to_numpy()
            starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            at = np.arange(len(conv)) - np.repeat(starts, np.diff(np.append(starts, len(conv))))
            if conv[0] == last:
                at[:starts[1] if len(starts) > 1 else len(at)] += done
            last, done = conv[-1], int(at[-1]) + 1
            yield _batch(conv_id=conv, pid=b.column("pid"), at=at, **{c: b.column(c) for c in ("d1", "d2", "len")})
    found = materialize(_sorted(rows, *order).select("conv_id", "pid", "d1", "d2", "len")
                        .mapInArrow(run, "conv_id long, pid int, at long, d1 long, d2 long, len long"), "turns")
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    # a partition goes on with one conversation at most, so there are fewer of these rows than partitions
    skip = found.groupBy("conv_id", "pid").agg(F.count(F.lit(1)).alias("n")).withColumn("skip", before).filter("skip is not null").drop("n")
    return found.join(F.broadcast(skip), ["conv_id", "pid"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("skip", F.lit(0))).alias("pos"), "d1", "d2", "len")


def plan(turns: DataFrame) -> DataFrame:
    """(conv_id, base, h, head, n): the base of each conversation, its number
    of shared turns, how many of these the base has, and its rebuilt length."""
    sizes = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    c = F.col("conv_id")
    convs = sizes.withColumn("base", c - c % GROUP).withColumn("h", F.crc32(c.cast("string").cast("binary")) % HEADS)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("has"))
    return (convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("has", F.lit(0).cast("long"))))
            .select("conv_id", "base", "h", "head", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))


def paths(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, n, depth, k1, k2, p1, p2, len): every turn of the rebuilt
    conversations, with the keys of the prefix that it ends and of the one
    before it."""
    own = turns.join(convs, "conv_id").filter("pos >= h").select("conv_id", "n", (F.col("pos") - F.col("h") + F.col("head") + 1).alias("depth"), "d1", "d2", "len")
    first = turns.filter((F.col("pos") < HEADS - 1) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "base")
    heads = first.join(convs, "base").filter("pos < head").select("conv_id", "n", (F.col("pos") + 1).alias("depth"), "d1", "d2", "len")

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            depth = b.column("depth").to_numpy().astype(np.uint64)
            x = [_mixed(b.column(d).to_numpy().view(np.uint64) ^ _mixed(depth * s)) for d, s in zip(("d1", "d2"), _STEP)]
            (k1, k2), held = _within(b.column("conv_id").to_numpy(), x, held)
            yield _batch(**{c: b.column(c) for c in ("conv_id", "n", "depth", "len", "pid")}, k1=k1.view(np.int64), k2=k2.view(np.int64),
                         p1=(k1 ^ x[0]).view(np.int64), p2=(k2 ^ x[1]).view(np.int64))
    found = materialize(_sorted(own.unionByName(heads), "conv_id", "depth").mapInArrow(
        run, "conv_id long, n long, depth long, len long, pid int, k1 long, k2 long, p1 long, p2 long"), "paths")
    span = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    skip = (found.groupBy("conv_id", "pid").agg(F.expr("bit_xor(k1 ^ p1)").alias("x1"), F.expr("bit_xor(k2 ^ p2)").alias("x2"))
            .select("conv_id", "pid", *(F.bit_xor(x).over(span).alias(f"s{x[1]}") for x in ("x1", "x2"))).filter("s1 is not null"))
    shift = lambda c: F.expr(f"{c} ^ coalesce(s{c[1]}, 0L)").alias(c)
    return found.join(F.broadcast(skip), ["conv_id", "pid"], "left").select("conv_id", "n", "depth", "len", *map(shift, ("k1", "k2", "p1", "p2")))


def nodes(path: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: its key, its parent's (p1, p2), conv_id, n_convs, len
    of its last text, and weight, the turns of its members from here on."""
    below = path.groupBy(*_KEY).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                                    F.min("len").alias("len"), F.sum(F.col("n") - F.col("depth") + 1).alias("weight"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("n") + 1).alias("weight")).filter("n_convs > 0")
    return below.unionByName(root.select(*(zero.alias(c) for c in (*_KEY, "p1", "p2", "len")), "conv_id", "n_convs", "weight"))


class SpillingQueue:
    """A priority queue of tuples of ``width`` integers with at most ``limit``
    in memory; the larger half of more goes to a file that the system deletes
    with the task, in order, and is read back by blocks."""

    def __init__(self, limit: int, width: int, block: int = 1024):
        self.limit, self.width, self.block = limit, width, block
        self.heap, self.runs, self.made = [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            items = sorted(self.heap)
            self.heap, rest = items[:len(items) // 2], items[len(items) // 2:]
            self._run(self._stored(rest))

    def _stored(self, items):
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        np.array(items, dtype=np.int64).tofile(file)
        file.seek(0)
        return self._read(file)

    def _read(self, file):
        with file:
            while (part := np.fromfile(file, dtype=np.int64, count=self.block * self.width)).size:
                yield from map(tuple, part.reshape(-1, self.width).tolist())

    def _run(self, items) -> None:
        head = next(items, None)
        if head is not None:
            self.made += 1
            heapq.heappush(self.runs, (head, self.made, items))

    def head(self) -> tuple | None:
        least = [q[0] for q in (self.heap, [r[0] for r in self.runs[:1]]) if q]
        return min(least, default=None)

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, _, items = heapq.heappop(self.runs)
            self._run(items)
            return item
        return heapq.heappop(self.heap)


def time_forward(rows: DataFrame) -> DataFrame:
    """(key, n_leaves, saved) of rows (key, p1, p2, piece key, leaves, saved):
    sums over the subtrees, each piece a whole subtree."""
    piece = [f"piece_{c}" for c in _KEY]
    limit = QUEUE

    def run(batches):
        queue = SpillingQueue(limit, 5)
        for b in batches:
            out = []
            for depth, k1, k2, p1, p2, d0, r1, r2, leaves, saved in zip(*(b.column(c).to_pylist() for c in (*_KEY, "p1", "p2", *piece, "leaves", "saved"))):
                key = (-depth, k1, k2)
                while (head := queue.head()) is not None and head[:3] == key:
                    _, _, _, x, y = queue.pop()
                    leaves, saved = leaves + x, saved + y
                out.append((depth, k1, k2, leaves, saved))
                if (depth, k1, k2) != (d0, r1, r2):
                    queue.push((1 - depth, p1, p2, leaves, saved))
            if out:
                yield _batch(**dict(zip((*_KEY, "n_leaves", "saved"), zip(*out))))
    return (rows.select(*_KEY, "p1", "p2", *piece, "leaves", "saved").repartition(*piece).sortWithinPartitions(F.col("depth").desc(), "k1", "k2")
            .mapInArrow(run, "depth long, k1 long, k2 long, n_leaves long, saved long"))


def totals(shared: DataFrame, path: DataFrame) -> DataFrame:
    """(key, n_leaves, saved) of the nodes ``shared`` (key, p1, p2, conv_id,
    weight, leaves, saved), shards first and then across their roots."""
    weight = shared.agg(F.max("weight")).first()[0] or 0
    rest, limit, done = shared, SHARD_TURNS, []
    while True:
        if weight <= limit:
            pieces = rest.select("*", *(F.lit(0).cast("long").alias(f"piece_{c}") for c in _KEY))
            done.append(materialize(time_forward(pieces), "totals"))
            break
        heavy = materialize(rest.filter(F.col("weight") > limit), "heavy")
        # of each conversation the deepest node below a heavy one: its light subtree's root, or heavy itself
        above = heavy.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"))
        roots = path.join(above, ["depth", "p1", "p2"]).groupBy("conv_id").agg(F.max(F.struct(*_KEY)).alias("r")).select("conv_id", *(F.col(f"r.{c}").alias(f"piece_{c}") for c in _KEY))
        light = materialize(rest.filter(F.col("weight") <= limit).join(roots, "conv_id"), "light")
        found = materialize(time_forward(light), "totals")
        done.append(found)
        tops = light.filter(" and ".join(f"{c} = piece_{c}" for c in _KEY)).select(*_KEY, "p1", "p2").join(found, _KEY)
        up = tops.groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.sum("n_leaves").alias("x"), F.sum("saved").alias("y"))
        zero = F.lit(0).cast("long")
        rest = materialize(heavy.join(up, _KEY, "left").withColumn("leaves", F.col("leaves") + F.coalesce("x", zero))
                           .withColumn("saved", F.col("saved") + F.coalesce("y", zero)).drop("x", "y"), "rest")
        limit *= SHARD_TURNS
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def ends(path: DataFrame, convs: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes at which conversations end."""
    zero = [F.lit(0).cast("long").alias(c) for c in _KEY]
    rows = path.filter("depth = n").select(*_KEY, "conv_id").unionByName(convs.filter("n = 0").select(*zero, "conv_id"))
    chunk = CHUNK

    def join(batches):
        seq = 0
        for b in batches:
            if not b.num_rows:
                continue
            key = [b.column(c).to_numpy() for c in _KEY]
            new = np.zeros(b.num_rows, dtype=bool)
            for k in key:
                new[1:] |= k[1:] != k[:-1]
            cuts = np.flatnonzero(new)
            cuts = np.unique(np.concatenate([[0], cuts, np.arange(0, b.num_rows, chunk)]))
            conv = list(map(str, b.column("conv_id").to_pylist()))
            at = cuts.tolist() + [b.num_rows]
            yield _batch(**{c: k[cuts] for c, k in zip(_KEY, key)}, pid=b.column("pid").to_numpy()[cuts], seq=np.arange(seq, seq + len(cuts)),
                         ids=[",".join(conv[s:e]) for s, e in zip(at, at[1:])])
            seq += len(cuts)

    def digest(batches):
        key, sha = None, None
        for b in batches:
            out = []
            for d, k1, k2, ids in zip(*(b.column(c).to_pylist() for c in (*_KEY, "ids"))):
                if (d, k1, k2) != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = (d, k1, k2), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield _batch(**dict(zip((*_KEY, "ends_sha256"), zip(*out))))
        if key:
            yield _batch(**dict(zip((*_KEY, "ends_sha256"), zip((*key, sha.hexdigest())))))
    chunks = _sorted(rows, *_KEY, "conv_id").mapInArrow(join, "depth long, k1 long, k2 long, pid int, seq long, ids string")
    return (materialize(chunks, "ends").repartition(*_KEY).sortWithinPartitions(*_KEY, "pid", "seq")
            .mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    turns = positions(conversations)
    convs = materialize(plan(turns), "conversations")
    path = paths(turns, convs)
    tree = materialize(nodes(path, convs), "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = tree.filter("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("alone"))
    zero = F.lit(0).cast("long")
    tree = materialize(tree.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)).withColumn("alone", F.coalesce("alone", zero)), "tree")
    shared = tree.filter("n_convs > 1").select(*_KEY, "p1", "p2", "conv_id", "weight", ((F.col("n_children") == 0).cast("long") + F.col("alone")).alias("leaves"),
                                               ((F.col("n_convs") - 1) * F.col("len")).alias("saved"))
    parents = tree.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (tree.join(totals(shared, path), _KEY, "left").join(ends(path, convs), _KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
            .select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
                    F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")))
