"""Benchmark decontamination by template canonicalisation.

A text becomes template words: lower-case words without punctuation, where
numbers, measurement units and names (a capitalised word inside a sentence)
are replaced by typed placeholders (signs of currencies and numbers are no
part of them, and with ``both=True`` a capitalised word that opens a sentence
is a name too unless ``literal_words`` has it), so a question asked again with other
parameters has the template of the original.  Windows of eight template words
of documents and benchmark items meet by their hash.  Where a window has
placeholders, the values behind them are compared along the alignment: each
value of the item must stand for one value in the document, wherever it
recurs, or the alignment does not count.

A document is contaminated by an item when its consistent windows cover half
of the item's windows, or six of them (thirteen words in a row).

Templates depend on case and sentence marks, so the queries (``both=True``)
also hash every window as plain lower-case words without marks, and a finding
of either kind counts.  Plain windows have no literals to ask for, template
windows with one to three count beside one with four, shares are of all
windows of the item, and only windows on near alignments add up.  The
template kind alone, ``both=False``, is what the tests hold against its rules.

Everything is native expressions: window hashes are made and tested inside
each row against the benchmark's set of hashes, so only matching windows
leave a document and no window of the corpus is shuffled.  That set is
checked to be small (``literal_limit``); a larger benchmark goes through a
shuffled hash join instead, with equal results.

Null and empty texts have no template words and match nothing; items shorter
than a window are one window of their own length; items without four literal
words in any window are matched by plain words only; items of equal text are all reported;
a document id that repeats is reported for each row, with the findings of all
rows of that id; null ids are never reported as contaminated; empty tables
give empty tables, or no findings; other columns are ignored.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, text_or_empty

WINDOW, LEAST_LITERALS, ENOUGH_WINDOWS = 8, 4, 6
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"
# Measurement units written in full or abbreviated.
UNITS = ("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres "
         "kilometer kilometers mg g kg t oz lb lbs gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces "
         "ml l litre litres liter liters gallon gallons s sec min h hr hrs second seconds minute minutes hour hours day days week "
         "weeks month months year years hz khz mhz ghz w kw mw j kj kwh v kv a pa bar k kb mb gb tb byte bytes bit bits percent "
         "dollar dollars euro euros cent cents usd eur gbp").split()
# Number words.
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
                "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion").split()
# Single letters and short words that are units only after a number.
AFTER_NUMBER = tuple(u for u in UNITS if len(u) <= 2)
END = "\x01"
# Marks that part words of the plain kind; those left out join the letters around them.
_PARTING = ":;()[]{}<>/\\|\"“”„«»*#_~`=+…–—"
_JOINING = ".!?,'’‘^¡¿-−&%$€£¥@" + END
_ENDS = ".!?"
_DROPPED = ",;:\"()[]{}<>«»“”„…¡¿|*#_~`^=+\\/$€£¥–—−" + END


def with_words(rows: DataFrame, text: str | Column) -> DataFrame:
    """``rows`` plus w, the words of a text (one that ends a sentence carries
    a mark), and l, the same words in lower case without marks."""
    marked = F.translate(text_or_empty(text), _DROPPED + _ENDS, " " * len(_DROPPED) + END * len(_ENDS))
    rows = rows.withColumn("__e", F.regexp_replace(marked, END + "+", END))
    low = F.lower(F.replace("__e", F.lit(END), F.lit("")))
    return rows.withColumns({"w": F.filter(F.split("__e", r"\s+"), lambda w: (w != "") & (w != END)),
                             "l": F.filter(F.split(low, r"\s+"), lambda w: w != "")}).drop("__e")


def template(words: Column, low: Column, literal: list[int] | None = None) -> Column:
    """Template words.  The common case, a word already in lower case, is
    decided by three comparisons; only the others are looked at closely.  A
    capitalised word that opens a sentence stays literal or, with ``literal``,
    is a name unless its hash is among these."""
    def one(x: Column, i: Column) -> Column:
        word = F.get(words, i)
        before = F.when(i > 0, F.get(words, i - 1)).otherwise(F.lit(END))
        digit = lambda w: (w >= "0") & (w < ":")  # noqa: E731  starts with one
        bare = F.translate(word, END, "")
        tail = F.substring(bare, 2, 1 << 30)
        inside = ~F.contains(before, F.lit(END))
        name = ((F.substring(bare, 1, 1) != F.substring(x, 1, 1)) & (tail != "") & (tail == F.substring(x, 2, 1 << 30))
                & (inside if literal is None else inside | ~F.xxhash64(x).isin(literal)))
        # twenty-five, -3
        joined = (F.contains(x, F.lit("-")) & (F.translate(x, "-", "") != "")
                  & F.forall(F.split(x, "-"), lambda y: (y == "") | digit(y) | y.isin(*NUMBER_WORDS)))
        return (F.when(digit(x) | x.isin(*NUMBER_WORDS) | joined, F.lit(NUMBER))
                .when(x.isin(*UNITS) & (~x.isin(*AFTER_NUMBER) | digit(F.translate(before, "-", ""))), F.lit(UNIT))
                .when((word != x) & name, F.lit(NAME)).otherwise(x))
    return F.transform(low, one)


def with_template(rows: DataFrame, text: str | Column, literal: list[int] | None = None) -> DataFrame:
    """``rows`` plus w, l and t, the template words of a text."""
    return with_words(rows, text).withColumn("t", template(F.col("w"), F.col("l"), literal))


def literal_words(docs: DataFrame, benchmark: DataFrame, text_col: str) -> list[int]:
    """Hashes of the words that are no names where they open a sentence: those of the
    benchmark seen in lower case there or in three documents, unless they are
    seen capitalised inside its sentences more often.  A word that is in no
    item can be a name, as no window has it otherwise; so the list is no
    longer than the benchmark's vocabulary."""
    rows = with_words(benchmark.select(F.col(text_col).alias("text")), "text")
    at = F.transform("w", lambda w, i: F.struct(
        F.get("l", i).alias("x"), (F.translate(w, END, "") == F.get("l", i)).cast("int").alias("low"),
        ((F.translate(w, END, "") != F.get("l", i)) & (i > 0) & ~F.contains(F.get("w", i - 1), F.lit(END))).cast("int").alias("inside")))
    seen = rows.select(F.explode(at).alias("y")).groupBy("y.x").agg(F.sum("y.low").alias("low"), F.sum("y.inside").alias("inside"))
    seen = materialize(seen, "item-vocabulary")
    asked = [r.x for r in seen.filter("low = 0 or inside >= low").select("x").collect()]     # at most the benchmark's vocabulary
    if not asked:
        return sorted(r[0] for r in seen.select(F.xxhash64("x")).collect())
    there = F.array_distinct(F.filter(F.split(text_or_empty("text"), " "), lambda w: w.isin(asked)))
    common = docs.select(F.explode_outer(there).alias("x")).filter("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    seen = seen.join(common, "x", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return sorted(r[0] for r in seen.filter("(low > 0 or n >= 3) and low + n >= inside").select(F.xxhash64("x")).collect())


def with_plain(rows: DataFrame, text: str | Column) -> DataFrame:
    """``rows`` plus p, the lower-case words of a text without marks."""
    low = F.translate(F.lower(text_or_empty(text)), _PARTING + _JOINING, " " * len(_PARTING))
    return rows.withColumn("p", F.filter(F.split(low, r"\s+"), lambda w: w != ""))


def is_slot(word: Column) -> Column:
    return word.isin(NUMBER, UNIT, NAME)


def with_hashes(rows: DataFrame, sizes: list[int], words: str = "t", name: str = "h") -> DataFrame:
    """``rows`` plus h<n>, the hashes of all windows of n template words, for
    each size.  A window's hash is that of the hashes of its two parts, so
    eight words cost three steps and no window is ever copied."""
    done = {1}
    rows = rows.withColumn(f"{name}1", F.transform(words, lambda x: F.xxhash64(x)))

    def need(n: int) -> None:
        nonlocal rows
        if n in done:
            return
        a = 1 << ((n - 1).bit_length() - 1)
        need(a)
        need(n - a)
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        rows = rows.withColumn(f"{name}{n}", F.transform(starts, lambda i: F.xxhash64(F.get(f"{name}{a}", i), F.get(f"{name}{n - a}", i + a))))
        done.add(n)
    for n in sizes:
        need(n)
    return rows


def window_at(start: Column, h: Column, size) -> Column:
    """One window of a row: place, hash, values behind its placeholders."""
    kinds = F.slice("t", start + 1, size)
    raw = F.slice("l", start + 1, size)
    values = F.filter(F.transform(raw, lambda w, j: F.when(is_slot(F.get(kinds, j)), w)), F.isnotnull)
    return F.struct(start.alias("pos"), h.alias("h"), values.alias("slots"))


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, literal: list[int] | None = None, least: int = LEAST_LITERALS) -> DataFrame:
    """(item_id, size, pos, h, slots, strong, windows): the items' windows with
    at least ``least`` literal words, whether these are enough, and their
    number; with another ``least``, the number of all windows."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    rows = materialize(with_template(rows, "text", literal).withColumn("size", F.least(F.size("t"), F.lit(WINDOW))), "item-words")
    asked = lambda n: F.least(F.col("size"), F.lit(n))
    literals = lambda i: F.size(F.filter(F.slice("t", i + 1, F.col("size")), lambda x: ~is_slot(x)))
    starts = F.sequence(F.lit(0), F.size("t") - F.col("size"))
    enough = F.filter(starts, lambda i: literals(i) >= asked(least))
    number = F.size("e") if least == LEAST_LITERALS else F.size("t") - F.col("size") + 1
    out = []
    for n in range(1, WINDOW + 1):
        own = with_hashes(rows.filter(F.col("size") == n), [n]).withColumn("e", enough)
        own = own.select("item_id", "size", "t", number.alias("windows"), F.explode_outer(_cut(n)).alias("x")).filter("x is not null")
        out.append(own.withColumn("strong", literals(F.col("x.pos")) >= asked(LEAST_LITERALS)))
    return reduce(DataFrame.unionByName, out).select("item_id", "size", "windows", "x.pos", "x.h", "x.slots", "strong")


def _cut(size: int) -> Column:
    """The windows of one size at the places in the column e."""
    return F.transform("e", lambda i: window_at(i, F.get(f"h{size}", i), size))


def plain_windows(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The columns of ``item_windows``: all windows of the items' plain words."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    rows = materialize(with_plain(rows, "text").withColumn("size", F.least(F.size("p"), F.lit(WINDOW))), "item-plain")
    out = []
    for n in range(1, WINDOW + 1):
        own = with_hashes(rows.filter(F.col("size") == n), [n], "p", "g")
        out.append(own.select("item_id", "size", F.size(f"g{n}").alias("windows"), F.posexplode_outer(f"g{n}").alias("pos", "h")).filter("h is not null"))
    none = F.array().cast("array<string>")
    return reduce(DataFrame.unionByName, out).select("item_id", "size", "windows", "pos", "h", none.alias("slots"), F.lit(True).alias("strong"))


def _known_plain(size: int, hashes: list[int]) -> Column:
    """``_known_windows`` for plain words."""
    places = F.sequence(F.lit(0), F.size(f"g{size}") - 1)
    at = F.when(F.size(f"g{size}") > 0, F.filter(places, lambda i: F.get(f"g{size}", i).isin(hashes))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.get(f"g{size}", i).alias("h")))


def matching_plain(docs: DataFrame, items: DataFrame, literal_limit: int) -> DataFrame:
    """``matching_windows`` for plain words."""
    hashes = items.select("size", "h").distinct()
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())         # at most WINDOW numbers
    rows = with_hashes(with_plain(docs, "text"), sizes, "p", "g")
    none = F.array().cast("array<string>")
    known = hashes.collect() if hashes.count() <= literal_limit else None           # at most literal_limit numbers
    out = []
    for n in sizes:
        if known is None:
            hits = rows.select("doc_id", F.posexplode_outer(f"g{n}").alias("pos", "h"))
            out.append(hits.join(hashes.filter(F.col("size") == n).select("h"), "h", "left_semi").select("doc_id", "pos", "h"))
            continue
        mine = [r.h for r in known if r["size"] == n]
        out.append(_known_plain(n, mine))
    if known is None:
        return reduce(DataFrame.unionByName, out).withColumn("slots", none)
    found = rows.select("doc_id", F.explode_outer(F.concat(*out)).alias("x")).filter("x is not null")
    return found.select("doc_id", "x.pos", "x.h", none.alias("slots"))


def _known_windows(size: int, hashes: list[int]) -> Column:
    """Windows of a size whose hash is among a few known ones."""
    places = F.sequence(F.lit(0), F.size(f"h{size}") - 1)
    at = F.when(F.size(f"h{size}") > 0, F.filter(places, lambda i: F.get(f"h{size}", i).isin(hashes))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: window_at(i, F.get(f"h{size}", i), size))


def matching_windows(docs: DataFrame, items: DataFrame, literal_limit: int, literal: list[int] | None = None) -> DataFrame:
    """(doc_id, pos, h, slots) of the windows of documents (doc_id, text)
    whose hash some item has."""
    hashes = items.select("size", "h").distinct()
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())         # at most WINDOW numbers
    rows = with_hashes(with_template(docs, "text", literal), sizes)
    if hashes.count() <= literal_limit:
        known = hashes.collect()                                                    # at most literal_limit numbers
        found = F.concat(*[_known_windows(n, [r.h for r in known if r["size"] == n]) for n in sizes])
        # outer, as an inner explode would first filter by its own input and so compute all windows twice
        found = rows.select("doc_id", F.explode_outer(found).alias("x")).filter("x is not null")
        return found.select("doc_id", "x.pos", "x.h", "x.slots")
    out = None
    for n in sizes:
        hits = (rows.select("doc_id", F.posexplode_outer(f"h{n}").alias("pos", "h"))
                .join(hashes.filter(F.col("size") == n).select("h"), "h", "left_semi"))
        # the few documents with a hit fetch the values behind their placeholders
        there = F.struct(window_at(F.col("pos"), F.col("h"), n).alias("x"), F.get(f"h{n}", F.col("pos")).alias("own"))
        hits = hits.join(rows.drop("h"), "doc_id").select("doc_id", "h", F.explode_outer(F.array(there)).alias("y"))
        hits = hits.filter(F.col("y.own") == F.col("h")).select("doc_id", "y.x.pos", "y.x.h", "y.x.slots").distinct()
        out = hits if out is None else out.unionByName(hits)
    return out


def findings(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
             item_text_col: str = "text", literal_limit: int = 100_000, both: bool = False) -> DataFrame:
    """(doc_id, item_id, matched, windows) for every contaminated document
    and item: consistent windows found, and windows of the item; with
    ``both``, by the kind of windows that covers more of it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    literal = literal_words(rows, benchmark, item_text_col) if both else None
    out = []
    for cut, matching in ((partial(item_windows, literal=literal, least=1 if both else LEAST_LITERALS), partial(matching_windows, literal=literal)),
                          (plain_windows, matching_plain))[:2 if both else 1]:
        items = materialize(cut(benchmark, item_col, item_text_col), "items")
        if not items.isEmpty():
            out.append(_covered(rows, items, matching, literal_limit, both))
    if not out:
        return spark.createDataFrame([], "doc_id long, item_id long, matched long, windows int")
    most = F.max_by(F.struct("matched", "windows"), F.col("matched") / F.col("windows")).alias("x")
    return reduce(DataFrame.unionByName, out).groupBy("doc_id", "item_id").agg(most).select("doc_id", "item_id", "x.*")


def _covered(rows: DataFrame, items: DataFrame, matching, literal_limit: int, runs: bool) -> DataFrame:
    """The findings by one kind of windows; with ``runs``, of windows on one
    alignment or on some that are a window or less apart."""
    theirs = items.select("h", "item_id", "windows", "size", "strong", F.col("pos").alias("at"), F.col("slots").alias("item_slots"))
    found = materialize(matching(rows, items, literal_limit).join(theirs, "h")
                        .withColumn("shift", F.col("pos") - F.col("at")), "found")
    line = ["doc_id", "item_id", "shift"]

    def torn(found: DataFrame) -> DataFrame:
        pairs = (found.filter(F.size("slots") > 0).select(*line, F.explode(F.arrays_zip("item_slots", "slots")).alias("p"))
                 .select(*line, F.col("p.item_slots").alias("theirs"), F.col("p.slots").alias("ours")))
        return (pairs.groupBy(*line, "theirs").agg(F.min("ours").alias("a"), F.max("ours").alias("b"))
                .filter("a <> b").select(*line).distinct())
    whole = found.filter("strong").join(torn(found.filter("strong")), line, "left_anti")
    if runs:
        # windows with few literals count where others support their alignment
        weak = found.filter("not strong")
        if not weak.isEmpty():
            weak = weak.join(whole.select(*line).distinct(), line, "left_semi")
            weak = weak.join(torn(weak.unionByName(whole)), line, "left_anti")
            whole = whole.unionByName(weak)
        whole = _filled(whole)
    matched = whole.groupBy("doc_id", "item_id", *(["run"] if runs else [])).agg(
        F.countDistinct("at").alias("matched"), F.first("windows").alias("windows"))
    return matched.filter((2 * F.col("matched") >= F.col("windows")) | (F.col("matched") >= ENOUGH_WINDOWS)).drop("run")


def _filled(hits: DataFrame) -> DataFrame:
    """(doc_id, item_id, run, at, windows): the windows of each alignment and
    those whose words they all cover; runs are alignments of which each is a
    window or less from the next."""
    lines = hits.groupBy("doc_id", "item_id", "shift").agg(
        F.sort_array(F.collect_set("at")).alias("ats"), F.first("size").alias("size"), F.first("windows").alias("windows"))
    place = Window.partitionBy("doc_id", "item_id").orderBy("shift")
    apart = F.coalesce(F.col("shift") - F.lag("shift").over(place) > WINDOW, F.lit(False)).cast("int")
    lines = lines.withColumn("apart", apart).withColumn("run", F.sum("apart").over(place))

    def to_next(at: Column, i: Column) -> Column:
        after = F.get("ats", i + 1)
        return F.when(after - at <= F.col("size"), F.sequence(at, after - 1)).otherwise(F.array(at))
    return lines.select("doc_id", "item_id", "run", "windows", F.explode(F.flatten(F.transform("ats", to_next))).alias("at"))


def contamination(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """One row per document: doc_id, contaminated, item_ids (sorted) and
    coverage, the largest covered share of an item."""
    hits = findings(docs, benchmark, **columns).groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max(F.col("matched") / F.col("windows")).alias("coverage"))
    out = docs.select(F.col(columns.get("id_col", "doc_id")).cast("long").alias("doc_id")).join(hits, "doc_id", "left")
    return out.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"),
                      F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
                      F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **columns) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept."""
    flagged = materialize(findings(docs, benchmark, **columns).select("doc_id").distinct(), "leaked")
    key = columns.get("id_col", "doc_id")
    return docs.join(flagged.withColumnRenamed("doc_id", key), key, "left_anti").select(*docs.columns)
