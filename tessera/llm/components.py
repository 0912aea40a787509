"""Connected components of a link table, and linking inside groups by blocks.

``connected_components`` alternates the large-star and small-star steps on a
table of edges until it stops changing.  Each step is a grouped minimum,
folded before the shuffle, and a join that adaptive execution may split, so a
hub with a third of all edges is no single task.  Every round is written to
the shared checkpoint folder and the one before is deleted.

``link_blocks`` finds the components of the link graph inside groups of any
size without holding a group in one task and without a row for each pair.
Groups are dealt into blocks; inside a block rows are compared in memory and
only a spanning forest leaves the task.  For groups of several blocks, the
heads of the blocks' components are compared next, and then every row that
is not in its group's largest component meets every block of the group, so
each pair of rows that are still apart is compared somewhere: no link between
two components is lost, whatever the sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.session import scratch_path


def _write(df: DataFrame, name: str):
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def _delete(spark, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in an edge; component is the smallest id
    reachable.  Null ends and loops are no edges."""
    spark = edges.sparkSession
    star, path = _write(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("hi") > F.col("lo"))).distinct(), "edges")
    mark = _mark(star)
    while mark[0]:
        both = star.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            star.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").filter("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new, new_path = _write(small.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        new_mark = _mark(new)
        _delete(spark, path)
        star, path, same, mark = new, new_path, new_mark == mark, new_mark
        if same:
            break
    return star.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(
        star.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


class Nibbles:
    """Rows of packed 4-bit minima, linked when few enough lanes differ."""

    def __init__(self, payloads, most_differing: int):
        self.rows = np.frombuffer(b"".join(payloads), dtype=np.uint64).reshape(len(payloads), -1)
        self.most = most_differing

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        return differing_lanes(self.rows[others], self.rows[i]) <= self.most


def differing_lanes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of 4-bit lanes in which rows of uint64 words differ."""
    d = x ^ y
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    d &= np.uint64(0x1111111111111111)
    return np.bitwise_count(d).sum(axis=-1, dtype=np.int64)


class Sets:
    """Rows of sorted distinct 64-bit items, linked when
    ``100 * intersection >= percent * union``."""

    def __init__(self, payloads, percent: int):
        sets = [np.frombuffer(p, dtype=np.uint64) for p in payloads]
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.items, code = np.unique(np.concatenate(sets), return_inverse=True)
        self.code, self.percent = code.astype(np.int32), percent
        self.flag = np.zeros(len(self.items), dtype=np.uint8)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        own = self.code[self.start[i]:self.start[i + 1]]
        self.flag[own] = 1
        if len(others) * 4 < len(self.size):
            both = np.array([self.flag[self.code[self.start[o]:self.start[o + 1]]].sum(dtype=np.int64) for o in others],
                            dtype=np.int64)
        else:
            both = np.add.reduceat(self.flag[self.code], self.start[:-1], dtype=np.int64)[others]
        self.flag[own] = 0
        return 100 * both >= self.percent * (self.size[i] + self.size[others] - both)


def forest(block, n: int) -> np.ndarray:
    """For each of n rows the first row of its component inside the block."""
    label = np.arange(n)
    apart = np.arange(1, n)                     # rows not reached yet
    root, queue = 0, [0]
    while True:
        while queue and len(apart):
            hit = block.linked(queue.pop(), apart)
            reached = apart[hit]
            label[reached] = root
            queue.extend(reached.tolist())
            apart = apart[~hit]
        if not len(apart):
            return label
        root, apart = int(apart[0]), apart[1:]
        queue = [root]


def runs(batches, keys: list[str], columns: list[str]):
    """Lists of column values (numpy for numbers, lists for the rest) for each
    run of equal keys in sorted rows; a run may span batches."""
    held: list = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ks = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cut = np.zeros(batch.num_rows, dtype=bool)
        cut[0] = True
        for k in ks:
            cut[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], batch.num_rows)
        cols = [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False)
                for c in (batch.column(n) for n in columns)]
        for s, e in zip(starts.tolist(), ends.tolist()):
            key = tuple(k[s] for k in ks)
            part = [c[s:e] for c in cols]
            if key == held_key:
                held.append(part)
                continue
            if held:
                yield held_key, _joined(held)
            held, held_key = [part], key
    if held:
        yield held_key, _joined(held)


def _joined(parts: list) -> list:
    if len(parts) == 1:
        return parts[0]
    return [[x for p in col for x in p] if isinstance(col[0], list) else np.concatenate(col) for col in zip(*parts)]


def deal(rows: DataFrame, block_rows: int, weight: str | None = None, block_weight: int = 1) -> DataFrame:
    """Rows (g, id, ...) of groups with at least two, plus k, the group's
    number of blocks, and blk, the row's; blocks hold about ``block_rows``
    rows, and ``block_weight`` of the column ``weight``, at most."""
    size = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *([F.sum(weight).alias("w")] if weight else []))
    k = F.ceil(F.col("n") / block_rows)
    if weight:
        k = F.greatest(k, F.ceil(F.col("w") / block_weight))
    size = size.filter("n > 1").select("g", F.least(k, F.col("n")).cast("int").alias("k"))
    return rows.join(size, "g").withColumn("blk", F.pmod(F.xxhash64("id", "g"), F.col("k")).cast("int"))


def _within(rows: DataFrame, make) -> DataFrame:
    """(g, k, id, label) for rows (g, k, blk, id, p): label is the smallest id
    of the row's component inside its block.  Rows alone in their component
    are left out unless their group has several blocks."""
    schema = "g long, k int, id long, label long"

    def run(batches):
        out, held = [], 0
        for (g, _), (ks, ids, payloads) in runs(batches, ["g", "blk"], ["k", "id", "p"]):
            n, k = len(ids), int(ks[0])
            if n == 1 and k == 1:
                continue
            label = forest(make(payloads), n) if n > 1 else np.zeros(1, dtype=np.int64)
            least = ids.copy()
            np.minimum.at(least, label, ids)
            lab = least[label]
            keep = np.ones(n, dtype=bool) if k > 1 else np.bincount(label, minlength=n)[label] > 1
            if keep.any():
                out.append((np.full(keep.sum(), g), np.full(keep.sum(), k, dtype=np.int32), ids[keep], lab[keep]))
                held += int(keep.sum())
            if held >= 8192:
                yield _table(out)
                out, held = [], 0
        if out:
            yield _table(out)

    def _table(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["g", "k", "id", "label"])
    return (rows.select("g", "k", "blk", "id", "p").repartition("g", "blk").sortWithinPartitions("g", "blk", "id")
            .mapInArrow(run, schema))


def _across(rows: DataFrame, make) -> DataFrame:
    """Edges (a, b) between rows of one side (side 0: apart from their group's
    largest component) and of a block (side 1), of different labels."""
    def run(batches):
        for _, (sides, ids, labels, payloads) in runs(batches, ["g", "blk", "chunk"], ["side", "id", "label", "p"]):
            block = make(payloads)
            labels = labels.copy()
            right = np.flatnonzero(sides == 1)
            found = []
            for i in np.flatnonzero(sides == 0):
                others = right[labels[right] != labels[i]]
                if not len(others):
                    continue
                for o in others[block.linked(i, others)]:
                    if labels[o] != labels[i]:
                        found.append((ids[i], ids[o]))
                        labels[labels == labels[o]] = labels[i]
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    return (rows.repartition("g", "blk", "chunk").sortWithinPartitions("g", "blk", "chunk", "side", "id")
            .mapInArrow(run, "a long, b long"))


def link_blocks(rows: DataFrame, make, block_rows: int) -> DataFrame:
    """Edges (a, b) that connect the components of the link graph inside each
    group of ``rows`` (g, k, blk, id, p), as ``deal`` lays them out.
    ``make(payloads)`` gives an object whose ``linked(i, others)`` compares."""
    first = materialize(_within(rows, make), "links")
    edges = first.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    many = first.filter("k > 1")
    if many.isEmpty():
        return edges
    rows = materialize(rows.filter("k > 1").select("g", "k", "blk", "id", "p"), "blocks")
    # heads of the blocks' components
    heads = many.select("g", F.col("label").alias("id")).distinct().join(rows.select("g", "id", "p"), ["g", "id"])
    second = materialize(_within(deal(heads, block_rows), make), "heads")
    edges = edges.union(second.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")))
    joined = second.select("g", F.col("id").alias("label"), F.col("label").alias("to"))
    many = many.join(joined, ["g", "label"], "left").select("g", "k", "id", F.coalesce("to", "label").alias("label"))
    # rows outside their group's largest component meet every block
    largest = (many.groupBy("g", "label").agg(F.count(F.lit(1)).alias("n"))
               .groupBy("g").agg(F.max(F.struct("n", "label"))["label"].alias("main")))
    many = materialize(many.join(largest, "g").withColumn("apart", F.col("label") != F.col("main")).drop("main"), "labels")
    chunks = many.filter("apart").groupBy("g").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("c"))
    if chunks.isEmpty():
        return edges
    full = many.join(rows.select("g", "id", "blk", "p"), ["g", "id"]).join(chunks, "g")
    count_to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = full.select("g", "blk", count_to("c").alias("chunk"), F.lit(1).alias("side"), "id", "label", "p")
    left = full.filter("apart").select("g", count_to("k").alias("blk"), F.pmod(F.xxhash64("id"), F.col("c")).cast("int").alias("chunk"),
                                       F.lit(0).alias("side"), "id", "label", "p")
    return edges.union(materialize(_across(left.unionByName(right), make), "across"))
