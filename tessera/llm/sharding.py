"""Sharding by a hierarchical weighted hash tree.

A row descends region -> rack -> shard.  At each level every child draws
``ln(u) / weight`` with ``u`` in (0, 1] hashed from the key and the child's
name, and the largest draw wins, so a child wins with probability
proportional to its weight, and raising one child's weight can only move rows
into that child's subtree: no row moves between two other subtrees.  A shard
added as a region of its own is therefore the only one that receives rows.

The tree is a bounded parameter (names and weights), so placement is one
projection of native expressions: no shuffle, no state.  Slots (gapless row
numbers inside each shard) cost one narrow shuffle, dealt over
``slot_buckets`` sub-ranges of every shard so that a shard holding a third of
the rows is still many tasks.

Null keys hash as the empty key and so share one shard; repeated rows share a
shard and get slots of their own; an empty table gives an empty table; other
input columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import materialize, text_or_empty, unsigned_part

SHARD_OVERHEAD = 16


@dataclass(frozen=True)
class Tree:
    """regions: ((rack, ...), ...), rack: ((shard id, weight), ...)."""
    regions: tuple

    def shards(self) -> list[int]:
        return [s for region in self.regions for rack in region for s, _ in rack]

    def with_region(self, shard: int, weight: float = 1.0) -> "Tree":
        """The tree after one more shard, a region of its own."""
        return Tree(self.regions + ((((shard, weight),),),))


def even_tree(shards: int, racks_per_region: int = 5, shards_per_rack: int = 2) -> Tree:
    """Shards 0..n-1 of weight 1 in full racks and regions, in order."""
    racks = [tuple((s, 1.0) for s in range(i, min(i + shards_per_rack, shards)))
             for i in range(0, shards, shards_per_rack)]
    return Tree(tuple(tuple(racks[i:i + racks_per_region]) for i in range(0, len(racks), racks_per_region)))


def _weight(node) -> float:
    return node[1] if not isinstance(node[0], tuple) else sum(_weight(x) for x in node)


def _draw(key: Column, name: str, weight: float, seed: int) -> Column:
    u = (unsigned_part(F.concat(F.lit(f"{seed}/{name}/"), key)) + F.lit(1)) / F.lit(float(1 << 52))
    return F.log(u) / F.lit(float(weight))


def _winner(draws: list[Column]) -> Column:
    """Index of the largest draw; of equal draws the first."""
    tagged = F.array(*[F.struct(d.alias("d"), F.lit(-i).alias("i")) for i, d in enumerate(draws)])
    return -F.array_max(tagged)["i"]


def place(df: DataFrame, key: Column, tree: Tree, out: str = "shard", seed: int = 0) -> DataFrame:
    """``df`` plus the shard of each row.  Each level's draws are made only
    for the children of the node that won above."""
    k = text_or_empty(key)

    def among(children, name):
        return _winner([_draw(k, f"{name}.{i}", _weight(c), seed) for i, c in enumerate(children)])

    region, rack, leaf = "__region", "__rack", out
    df = df.withColumn(region, among(tree.regions, "r"))
    racks = F.lit(None).cast("int")
    for i, r in enumerate(tree.regions):
        racks = F.when(F.col(region) == i, among(r, f"r.{i}")).otherwise(racks)
    df = df.withColumn(rack, racks)
    shard = F.lit(None).cast("int")
    for i, r in enumerate(tree.regions):
        for j, c in enumerate(r):
            ids = F.array(*[F.lit(s) for s, _ in c])
            won = among(c, f"r.{i}.{j}")
            shard = F.when((F.col(region) == i) & (F.col(rack) == j), F.get(ids, won)).otherwise(shard)
    return df.withColumn(leaf, shard.cast("int")).drop(region, rack)


def slots(df: DataFrame, shard: str, order: list[str], slot_buckets: int = 64, out: str = "slot") -> DataFrame:
    """``df`` plus gapless row numbers from 0 inside each shard.

    Rows are numbered inside (shard, sub-range), and each sub-range starts
    where the ones before it end; the table of starts has shards x
    ``slot_buckets`` rows whatever the input."""
    b = "__bucket"
    spread = unsigned_part(F.concat(F.lit("slot/"), text_or_empty(order[0])))
    rows = materialize(df.withColumn(b, (spread % F.lit(slot_buckets)).cast("int")), "slots")
    before = Window.partitionBy(shard).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy(shard, b).agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    own = Window.partitionBy(shard, b).orderBy(*order)
    numbered = rows.withColumn("__i", F.row_number().over(own) - 1)
    # proven bound: one row for each of shards x slot_buckets
    return (numbered.join(F.broadcast(starts), [shard, b])
            .withColumn(out, (F.col("__i") + F.col("__start")).cast("long")).drop(b, "__i", "__start"))


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40,
                    seed: int = 0, slot_buckets: int = 64) -> DataFrame:
    """One row per document: id, size (UTF-8 bytes plus 16), text_crc32, law
    ("key"), shard, slot and grown_shard, the shard after one more is added."""
    tree = even_tree(shards)
    text = text_or_empty(text_col)
    d = df.select(F.col(id_col).alias("doc_id"),
                  (F.octet_length(text) + F.lit(SHARD_OVERHEAD)).cast("long").alias("size"),
                  F.crc32(text).cast("long").alias("text_crc32"))
    d = place(d, F.col("doc_id"), tree, "shard", seed)
    grown = tree.with_region(shards)
    key = text_or_empty(F.col("doc_id"))
    top = [_draw(key, f"r.{i}", sum(_weight(x) for x in r), seed) for i, r in enumerate(grown.regions)]
    # the other regions' draws are as before, so the row moves only if the new region's is the largest
    d = d.withColumn("grown_shard", F.when(top[-1] > F.greatest(*top[:-1]), F.lit(shards))
                     .otherwise(F.col("shard")).cast("int"))
    d = slots(d, "shard", ["doc_id", "size", "text_crc32"], slot_buckets)
    return d.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
