"""Labels: class lists, multi-hot vectors, renames, support and
co-occurrence (L1-L6, A4-A6, U3, P4, J9).

A class list is model metadata (the reference fixes 44 or 45 names).  It is
the only thing collected to the driver here, and only after its size is
checked against ``max_classes``; everything per article stays in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CLASSES = 100_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def distinct_classes(df: DataFrame, cats_col: str = "cats") -> DataFrame:
    """A4: distinct class names, sorted (map-side partial distinct)."""
    return df.select(F.explode(cats_col).alias("class")).distinct().orderBy("class")


@dataclass
class ClassList:
    names: list

    def array(self) -> Column:
        return F.array(*[F.lit(n) for n in self.names]).cast("array<string>")

    def multihot(self, cats) -> Column:
        """L1: one int per class, in the given class order; unknown labels
        ignored."""
        return F.transform(self.array(), lambda c: F.array_contains(_col(cats), c).cast("int"))

    def class_ids(self, cats) -> Column:
        """L3: categories -> list of class ids (order of the categories kept,
        unknown names dropped)."""
        arr = self.array()
        ids = F.transform(_col(cats), lambda c: F.array_position(arr, c) - 1)
        return F.filter(ids, lambda i: i >= 0)

    def expand(self, df: DataFrame, cats_col: str) -> DataFrame:
        """Long form: one row per (article, class) with y = membership."""
        return (df.select("*", F.posexplode(self.array()).alias("class_idx", "class"))
                .withColumn("y", F.array_contains(F.col(cats_col), F.col("class")).cast("int")))


def class_table(df: DataFrame, cats_col: str = "cats", max_classes: int = MAX_CLASSES) -> ClassList:
    """Learn the sorted class list from the data (L2), size-checked first."""
    rows = distinct_classes(df, cats_col).limit(max_classes + 1).collect()  # one job, bounded
    if len(rows) > max_classes:
        raise ValueError(f"more than max_classes={max_classes} classes; pass the class list explicitly")
    return ClassList([r["class"] for r in rows])


def one_hot_from_ids(ids, n_classes: int) -> Column:
    """L4: id list -> one-hot row of length n_classes."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                       lambda i: F.array_contains(_col(ids), i).cast("int"))


def wide_columns(df: DataFrame, labels_col: str, names) -> DataFrame:
    """One column per class from a multi-hot array (same-row select,
    no join)."""
    return df.select(*[c for c in df.columns if c != labels_col],
                     *[F.col(labels_col)[i].alias(n) for i, n in enumerate(names)])


def rename_classes(cats, mapping: dict) -> Column:
    """Rename through a fixed map, unknown names unchanged; order and
    duplicates kept."""
    if not mapping:
        return _col(cats)
    m = F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    return F.transform(_col(cats), lambda c: F.coalesce(F.element_at(m, c), c))


def has_label(cats, name: str) -> Column:
    """P4 by name."""
    return F.array_contains(_col(cats), F.lit(name))


def support(long_df: DataFrame, class_col: str = "class", y_col: str = "y",
            pred_col: str | None = "pred") -> DataFrame:
    """A5: true (and predicted) support per class, ascending by count then
    class (O3)."""
    aggs = [F.sum(y_col).cast("long").alias("n_true")]
    if pred_col:
        aggs.append(F.sum(pred_col).cast("long").alias("n_pred"))
    return long_df.groupBy(class_col).agg(*aggs)


def cooccurrence(long_df: DataFrame, id_col: str = "id", class_col: str = "class",
                 y_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """For each true class t and predicted class p, the number of
    articles labelled t and predicted p.

    One grouping gathers an article's true and its predicted classes; pairs
    are emitted only between the two, both bounded by the class list."""
    both = long_df.groupBy(id_col).agg(F.collect_set(F.when(F.col(y_col) == 1, F.col(class_col))).alias("__t"),
                                       F.collect_set(F.when(F.col(pred_col) == 1, F.col(class_col))).alias("__p"))
    pairs = both.select(F.explode("__t").alias("true_class"), "__p").select(
        "true_class", F.explode("__p").alias("pred_class"))
    return pairs.groupBy("true_class", "pred_class").agg(F.count(F.lit(1)).alias("n"))
