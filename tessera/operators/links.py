"""Link graph: outlink extraction and cleaning, title -> page-id mapping,
inlinks by namespace, in/out join (G1-G9, W4, U6, U7, J1, J4, S4, T15, T16).

Inlinks are kept in long form (qid, pos, pid, ns) -- one row per link -- so
a hub article with a huge in-degree is spread over tasks.  The model table
keeps them as pages, (qid, side, page, ids) of at most PAGE ids, so no row
grows with the degree; whole lists are only put together from pages where a
result shows them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import WHITE_SPACE
from tessera.operators.lookup import lookup_tokens
from tessera.operators.vocab import rank_within
from tessera.session import materialize

# Namespace numbers and names.
SUBJECT_NAMESPACES = {0: "article", 2: "user", 4: "wikipedia", 6: "file", 8: "media-wiki", 10: "template",
                      12: "help", 14: "category", 100: "portal", 108: "book", 118: "draft",
                      710: "timed-text", 828: "module"}
TALK_NAMESPACES = {1: "article", 3: "user", 5: "wikipedia", 7: "file", 9: "media-wiki", 11: "template",
                   13: "help", 15: "category", 101: "portal", 109: "book", 119: "draft",
                   711: "timed-text", 829: "module"}
IGNORED_NAMESPACES = [446, 447, 2300, 2301, 2302, 2303]

# Openings and closings of links.  Of a run of brackets the last two open (an
# odd one before them is text) and the first two close.
OPENING_RE = r"\[\[(?=(?:\[\[)*(?!\[))"
CLOSING_RE = r"\]\]"
CUT, NOT_CUT = "\ufdd0", "\ufdd1"         # characters that no text should hold; of equal length
FOLD_BLOCK = 256
PAGE = 4096                              # links of an article in one row
NAMESPACED_LINK_RE = r"\[\[[^\]]*:[^\]]*\]\]"
TITLE_BEFORE_PIPE_RE = r"(\[\[[^\n]*?\|)"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value, body) -> Column:
    """``body(value)`` with the value computed once, wherever it stands."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def extract_links(text) -> Column:
    """G1: raw [[...]] links in text order of their openings, of any depth; a
    link that holds others (an image caption, say) comes before them.

    The text is cut at its openings and closings, and one fold over the pieces
    keeps the places of the links that are open: a closing takes the last.  A
    closing with none open, and an opening that is never closed, are text; null
    text gives null.  The fold goes by blocks, whose links are appended
    together, as appending one by one copies the list each time."""
    t = _col(text)
    marked = F.regexp_replace(F.translate(t, CUT, NOT_CUT), CLOSING_RE, "]]" + CUT)
    pieces = F.split(F.regexp_replace(marked, OPENING_RE, CUT + "[["), CUT)

    none = F.array().cast("array<struct<s:int,e:int>>")

    def piece(acc, x):
        def closed(opened):
            end = acc["at"] + F.length(x)
            closes = F.endswith(x, F.lit("]]")) & (F.size(opened) > 0)
            last = F.struct(F.get(opened, F.size(opened) - 1).alias("s"), end.alias("e"))
            return F.struct(end.alias("at"), F.when(closes, F.slice(opened, 1, F.size(opened) - 1)).otherwise(opened).alias("open"),
                            F.when(closes, F.concat(acc["links"], F.array(last))).otherwise(acc["links"]).alias("links"))
        return _let(F.when(F.startswith(x, F.lit("[[")), F.concat(acc["open"], F.array(acc["at"]))).otherwise(acc["open"]), closed)

    def all_of(parts):
        def block(acc, i):
            done = F.aggregate(F.slice(parts, i * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)),
                               F.struct(acc["at"].alias("at"), acc["open"].alias("open"), none.alias("links")), piece)
            return _let(done, lambda d: F.struct(d["at"].alias("at"), d["open"].alias("open"), F.concat(acc["links"], d["links"]).alias("links")))
        blocks = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / FOLD_BLOCK).cast("int"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("open"), none.alias("links"))
        return F.sort_array(F.aggregate(blocks, start, block, lambda acc: acc["links"]))

    return F.when(t.isNotNull(), F.transform(_let(pieces, all_of), lambda x: F.substring(t, x["s"] + 1, x["e"] - x["s"])))


def link_target(raw) -> Column:
    """G2 for one raw link: text between the brackets up to the first |."""
    inner = F.substring(raw, F.lit(3), F.length(raw) - 4)
    return F.split(inner, r"\|").getItem(0)


def lower_first(s) -> Column:
    """Lower-case the first character only."""
    s = _col(s)
    return F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, F.lit(2147483647)))


def clean_title(raw) -> Column:
    """G4 -> T16 -> T15 for one raw link: title before the pipe (or the
    link without brackets), spaces to underscores, first letter lowered."""
    head = F.regexp_extract(raw, TITLE_BEFORE_PIPE_RE, 1)
    title = F.when(head != "", F.replace(F.replace(head, F.lit("["), F.lit("")), F.lit("|"), F.lit(""))) \
        .otherwise(F.replace(F.replace(raw, F.lit("["), F.lit("")), F.lit("]"), F.lit("")))
    return lower_first(F.replace(title, F.lit(" "), F.lit("_")))


def clean_links(raw_links) -> Column:
    """Drop namespaced links (any ':' inside, G3), then clean titles."""
    kept = F.filter(_col(raw_links), lambda l: ~l.rlike(NAMESPACED_LINK_RE))
    return F.transform(kept, lambda l: clean_title(l))


def title_map(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """TSV lines title<TAB>page_id; lines without exactly two fields are
    skipped, white space around a line is not part of it; the key's first
    letter is lowered; the last line wins (by file, then the offset of the
    block, then the line in it)."""
    parts = lines.select(F.split(F.btrim(value_col, F.lit(WHITE_SPACE)), "\t").alias("__f"),
                         F.input_file_name().alias("__file"), F.input_file_block_start().alias("__block"),
                         F.monotonically_increasing_id().alias("__line"))
    ok = parts.filter(F.size("__f") == 2).select(
        lower_first(F.col("__f")[0]).alias("title"), F.col("__f")[1].alias("page_id"),
        F.struct("__file", "__block", "__line").alias("__order"))
    return ok.groupBy("title").agg(F.max_by("page_id", "__order").alias("page_id"))


def map_titles(df: DataFrame, id_col: str, links_col: str, mapping: DataFrame, out_col: str,
               default: str | None = "") -> DataFrame:
    """Every cleaned title -> page id, unmapped -> ``default`` (the
    reference keeps '' in the list, Q11; None drops them)."""
    found = lookup_tokens(df, id_col, links_col, mapping, F.col("page_id").cast("string"), (), "title")
    ids = F.transform("__s", lambda s: F.coalesce(s["value"], F.lit(default)))
    return found.select(id_col, (ids if default is not None else F.filter(ids, F.isnotnull)).alias(out_col))


def namespace_kind(ns) -> Column:
    """Subject for even, talk for odd namespaces (Q13: unknown numbers
    get the name 'unknown' instead of failing)."""
    ns = _col(ns)
    subj = F.create_map(*[x for k, v in SUBJECT_NAMESPACES.items() for x in (F.lit(k), F.lit(v))])
    talk = F.create_map(*[x for k, v in TALK_NAMESPACES.items() for x in (F.lit(k), F.lit(v))])
    kind = F.when(ns % 2 == 0, F.lit("subject")).otherwise(F.lit("talk"))
    name = F.coalesce(F.when(ns % 2 == 0, F.element_at(subj, ns)).otherwise(F.element_at(talk, ns)), F.lit("unknown"))
    return F.concat(kind, F.lit("_"), name)


def first_seen_namespaces(inl: DataFrame, qid: str = "qid", pos: str = "pos", ns: str = "ns") -> DataFrame:
    """W4 + U7: each article's distinct namespaces in first-seen order,
    ignored namespaces removed."""
    first = (inl.filter(~F.col(ns).isin(IGNORED_NAMESPACES))
             .groupBy(qid, ns).agg(F.min(pos).alias("__first")))
    return (first.groupBy(qid).agg(F.sort_array(F.collect_list(F.struct("__first", ns))).alias("__s"))
            .select(qid, F.transform("__s", lambda s: s[ns]).alias("namespaces")))


def links_by_namespace(inl: DataFrame, qid: str = "qid", pos: str = "pos", pid: str = "pid",
                       ns: str = "ns", as_lists: bool = True) -> DataFrame:
    """Inlinks split by namespace kind and name.  Long form (one row per
    link: qid, column, pos, pid) unless ``as_lists``, which rebuilds the
    reference's per-article list for each (article, namespace) -- only for
    consumers that need the list itself (the model table)."""
    k = inl.filter(~F.col(ns).isin(IGNORED_NAMESPACES)).withColumn("column", namespace_kind(ns))
    if not as_lists:
        return k.select(qid, "column", pos, pid)
    return (k.groupBy(qid, "column").agg(F.sort_array(F.collect_list(F.struct(pos, pid))).alias("__s"))
            .select(qid, "column", F.transform("__s", lambda s: s[pid]).alias("pids")))


def link_pages(rows: DataFrame, side: str, key: str = "qid", pos: str = "pos", pid: str = "pid", page: int = PAGE) -> DataFrame:
    """One side's links (key, pos, pid) as pages (key, side, page, ids),
    ids as strings in the order of place and id, ``page`` of them at most.
    Only links of articles with more than one page are ranked, all together
    over range-sorted partitions, so a hub is no single task's work either."""
    rows = rows.select(key, F.col(pos).alias("pos"), F.col(pid).alias("pid"))
    hubs = materialize(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > page).select(key), "hubs")
    paged = rows.join(hubs, key, "left_anti").withColumn("page", F.lit(0).cast("long"))
    if not hubs.isEmpty():
        many = rank_within(rows.join(hubs, key, "left_semi"), [key], ["pos", "pid"], "rank")
        paged = paged.unionByName(many.withColumn("page", F.floor(F.col("rank") / page)).drop("rank"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("pos", "pid"))), lambda x: x["pid"].cast("string"))
    return paged.groupBy(key, "page").agg(ids.alias("ids")).select(key, F.lit(side).alias("side"), "page", "ids")


def list_pages(lists: DataFrame, side: str, ids_col: str, key: str = "qid", page: int = PAGE) -> DataFrame:
    """Lists that stand in one row each, as an article's own outlinks do,
    as pages like those of ``link_pages``; cut in their row, without a shuffle."""
    some = lists.filter(F.size(ids_col) > 0)
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.size(ids_col) - 1) / page))).alias("page")
    ids = F.slice(F.col(ids_col).cast("array<string>"), (F.col("page") * page + 1).cast("int"), F.lit(page))
    return some.select(key, ids_col, number).select(key, F.lit(side).alias("side"), "page", ids.alias("ids"))


def with_both_sides(pages: DataFrame, key: str = "qid") -> DataFrame:
    """The pages of articles that have links on both sides."""
    both = pages.groupBy(key).agg(F.bool_or(F.col("side") == "in").alias("i"), F.bool_or(F.col("side") == "out").alias("o")).filter("i and o")
    return pages.join(both.select(key), key, "left_semi")


def encode_pages(pages: DataFrame, vocab: DataFrame, unk_id: int = 1, key: str = "qid") -> DataFrame:
    """The ids of every page as numbers of ``vocab`` (word, idx), page by
    page and both sides in one pass."""
    found = lookup_tokens(pages, key, "ids", vocab, F.col("idx").cast("long"), extra=("side", "page"), words=False)
    return found.select(key, "side", "page", F.transform("__s", lambda s: F.coalesce(s["value"], F.lit(unk_id).cast("long"))).alias("ids"))


def whole_lists(pages: DataFrame, key: str = "qid", in_col: str = "in_ids", out_col: str = "out_ids") -> DataFrame:
    """(key, in_col, out_col): each article's lists put together from its
    pages; an empty list for a side without."""
    def side(name):
        own = F.collect_list(F.when(F.col("side") == name, F.struct("page", "ids")))
        return F.flatten(F.transform(F.sort_array(own), lambda x: x["ids"]))
    return pages.groupBy(key).agg(side("in").alias(in_col), side("out").alias(out_col))
