"""Link-graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import links as lk
from tessera.operators import vocab as vb
from tessera.operators.rows import nonempty, with_status
from tessera.plans import views as V
from tessera.plans.catalog import register
from tessera.session import read_table

H1_RE = r"<h1[^>]*>([^<]*)</h1>"

_CLEAN_ONE = ("lower(substr(replace(CASE WHEN regexp_extract(l, '(\\[\\[[^\\n]*?\\|)', 1) <> '' "
              "THEN replace(replace(regexp_extract(l, '(\\[\\[[^\\n]*?\\|)', 1), '[', ''), '|', '') "
              "ELSE replace(replace(l, '[', ''), ']', '') END, ' ', '_'), 1, 1)) || "
              "substr(replace(CASE WHEN regexp_extract(l, '(\\[\\[[^\\n]*?\\|)', 1) <> '' "
              "THEN replace(replace(regexp_extract(l, '(\\[\\[[^\\n]*?\\|)', 1), '[', ''), '|', '') "
              "ELSE replace(replace(l, '[', ''), ']', '') END, ' ', '_'), 2)")

_LINK_SQL = f"""
WITH rawl AS (SELECT page_id, regexp_extract_all(raw, '\\[\\[[^\\[\\]]*\\]\\]', 0) AS raw_outlinks FROM outlinks),
cl AS (SELECT page_id, list_transform(list_filter(raw_outlinks,
         lambda l: NOT regexp_matches(l, '\\[\\[[^\\]]*:[^\\]]*\\]\\]')), lambda l: {_CLEAN_ONE}) AS outlinks FROM rawl),
tmap AS (SELECT lower(substr(w, 1, 1)) || substr(w, 2) AS title, arg_max(CAST(page_id AS VARCHAR), page_id) AS pid
         FROM (SELECT page_id, string_split(regexp_extract(html, '{H1_RE}', 1), ' ')[1] AS w FROM pages) GROUP BY 1),
op AS (SELECT c.page_id, u.title, u.pos FROM cl c,
       LATERAL (SELECT unnest(c.outlinks) AS title, generate_subscripts(c.outlinks, 1) AS pos) u),
mapped AS (SELECT op.page_id, list(coalesce(t.pid, '') ORDER BY op.pos) AS pid_outlinks
           FROM op LEFT JOIN tmap t USING (title) GROUP BY op.page_id
           UNION ALL SELECT page_id, []::VARCHAR[] FROM cl WHERE len(outlinks) = 0),
inl AS (SELECT q.qid, coalesce(a.pids, []::BIGINT[]) AS pid_inlinks FROM (SELECT DISTINCT qid FROM inlinks) q
        LEFT JOIN (SELECT qid, list(pid ORDER BY pos, pid) AS pids FROM inlinks WHERE ns = 0 GROUP BY qid) a USING (qid)),
jio AS (SELECT i.qid, i.pid_inlinks, m.pid_outlinks,
        CASE WHEN len(i.pid_inlinks) > 0 AND len(m.pid_outlinks) > 0 THEN 'kept' ELSE 'no_links' END AS status
        FROM inl i JOIN mapped m ON i.qid = m.page_id)
"""


def _title_map(spark, sf):
    p = read_table(spark, sf, "pages").select(
        "page_id", F.split(F.regexp_extract("html", H1_RE, 1), " ").getItem(0).alias("w"))
    return p.groupBy(lk.lower_first("w").alias("title")).agg(
        F.max_by(F.col("page_id").cast("string"), "page_id").alias("page_id"))


def _raw(spark, sf):
    return V.outlinks(spark, sf).select("page_id", lk.extract_links("raw").alias("raw_outlinks"))


def _clean(spark, sf):
    return _raw(spark, sf).select("page_id", lk.clean_links("raw_outlinks").alias("outlinks"))


def _titles(spark, sf):
    """Cleaned titles of every page, extracted once."""
    return V._shared(spark, "link_titles", sf, lambda: _clean(spark, sf), ("pages",))


def _mapped(spark, sf):
    return lk.map_titles(_titles(spark, sf), "page_id", "outlinks", _title_map(spark, sf), "pid_outlinks", "")


def all_pages(spark, sf):
    """Article-namespace inlinks and mapped outlinks as pages of both sides,
    written once: the join, the link vocabulary, the encoding and the link
    vectors all read them."""
    return V._shared(spark, "link_pages", sf, lambda: _pages(spark, sf), ("lineitem", "pages"))


def _pages(spark, sf):
    inl = V.inlinks(spark, sf)
    article = inl.filter(~F.col("ns").isin(lk.IGNORED_NAMESPACES) & (lk.namespace_kind("ns") == "subject_article"))
    out = _mapped(spark, sf).withColumnRenamed("page_id", "qid")
    return lk.link_pages(article, "in").unionByName(lk.list_pages(out, "out", "pid_outlinks"))


def kept_pages(spark, sf):
    """Pages of the articles with links on both sides."""
    return lk.with_both_sides(all_pages(spark, sf))


def _join_in_out(spark, sf):
    """The joined lists of every article with inlinks of any namespace that
    has a page; whole lists are made here, in the last step."""
    known = V.inlinks(spark, sf).select("qid").distinct().join(V.outlinks(spark, sf).select(F.col("page_id").alias("qid")), "qid", "left_semi")
    lists = lk.whole_lists(all_pages(spark, sf).join(known, "qid", "left_semi"), "qid", "pid_inlinks", "pid_outlinks")
    j = known.join(lists, "qid", "left").select(
        "qid", F.coalesce(F.col("pid_inlinks").cast("array<bigint>"), F.array().cast("array<bigint>")).alias("pid_inlinks"),
        F.coalesce("pid_outlinks", F.array().cast("array<string>")).alias("pid_outlinks"))
    checks = [("no_links", nonempty("pid_inlinks") & nonempty("pid_outlinks"))]
    return with_status(j, checks).select("qid", "pid_inlinks", "pid_outlinks", "status")


@register("link_extract", _LINK_SQL + "SELECT page_id, raw_outlinks FROM rawl", ["outlinks", "inlinks"])
def link_extract(spark, sf):
    """Raw [[...]] links of every page."""
    return _raw(spark, sf)


@register("link_targets", _LINK_SQL + """
SELECT page_id, list_transform(raw_outlinks, lambda l: string_split(substr(l, 3, length(l) - 4), '|')[1]) AS outlinks
FROM rawl""", ["outlinks", "inlinks"])
def link_targets(spark, sf):
    """Link target = text before the first '|' (namespaces kept)."""
    return _raw(spark, sf).select("page_id", F.transform("raw_outlinks", lk.link_target).alias("outlinks"))


@register("link_clean", _LINK_SQL + "SELECT page_id, outlinks FROM cl", ["outlinks", "inlinks"])
def link_clean(spark, sf):
    """Namespaced links dropped, titles cleaned."""
    return _clean(spark, sf)


@register("link_map_ids", _LINK_SQL + "SELECT page_id, pid_outlinks FROM mapped", ["outlinks", "inlinks"])
def link_map_ids(spark, sf):
    """Titles -> page ids through the title map ('' when unmapped)."""
    return _mapped(spark, sf)


@register("link_namespaces", """
SELECT qid, list(ns ORDER BY first) AS namespaces FROM
 (SELECT qid, ns, min(pos) AS first FROM inlinks WHERE ns NOT IN (446, 447, 2300, 2301, 2302, 2303) GROUP BY qid, ns)
GROUP BY qid
""", ["inlinks"])
def link_namespaces(spark, sf):
    """W4 + U7: distinct namespaces per article in first-seen order."""
    return lk.first_seen_namespaces(V.inlinks(spark, sf))


def _ns_case():
    s = " ".join(f"WHEN {k} THEN 'subject_{v}'" for k, v in lk.SUBJECT_NAMESPACES.items())
    t = " ".join(f"WHEN {k} THEN 'talk_{v}'" for k, v in lk.TALK_NAMESPACES.items())
    return (f"CASE ns {s} {t} ELSE CASE WHEN ns % 2 = 0 THEN 'subject_unknown' ELSE 'talk_unknown' END END")


@register("link_by_namespace", f"""
SELECT qid, {_ns_case()} AS "column", pos, pid FROM inlinks
WHERE ns NOT IN (446, 447, 2300, 2301, 2302, 2303)
""", ["inlinks"])
def link_by_namespace(spark, sf):
    """Inlinks split by namespace kind and name, in long form (one row
    per link, so a hub article's millions of inlinks never form one list)."""
    return lk.links_by_namespace(V.inlinks(spark, sf), as_lists=False)


@register("join_in_out", _LINK_SQL + "SELECT * FROM jio", ["outlinks", "inlinks"])
def join_in_out(spark, sf):
    """G8 + J1 + P5 + P2: article-namespace inlinks joined with mapped
    outlinks; rows without both lists flagged."""
    return _join_in_out(spark, sf)


_LV_SQL = """
, words AS (SELECT DISTINCT w FROM (SELECT CAST(unnest(pid_inlinks) AS VARCHAR) AS w FROM jio WHERE status = 'kept'
            UNION ALL SELECT unnest(pid_outlinks) AS w FROM jio WHERE status = 'kept')),
lv AS (SELECT w AS word, CAST(row_number() OVER (ORDER BY w) + 1 AS BIGINT) AS idx FROM words
       UNION ALL SELECT '<pad>', 0 UNION ALL SELECT '<unk>', 1)
"""


def link_vocabulary(spark, sf):
    return vb.build_vocab(kept_pages(spark, sf), "ids", prefix=(vb.PAD, vb.UNK))


@register("link_vocab", _LINK_SQL + _LV_SQL + "SELECT word, idx FROM lv", ["outlinks", "inlinks"])
def link_vocab(spark, sf):
    """U6 + W1: one vocabulary over in- and out-link ids (sorted, after
    <pad>, <unk>)."""
    return link_vocabulary(spark, sf)


@register("link_encode", _LINK_SQL + _LV_SQL + """
, ie AS (SELECT j.qid, u.w, u.pos FROM jio j, LATERAL (SELECT CAST(unnest(j.pid_inlinks) AS VARCHAR) AS w,
         generate_subscripts(j.pid_inlinks, 1) AS pos) u WHERE j.status = 'kept'),
oe AS (SELECT j.qid, u.w, u.pos FROM jio j, LATERAL (SELECT unnest(j.pid_outlinks) AS w,
         generate_subscripts(j.pid_outlinks, 1) AS pos) u WHERE j.status = 'kept'),
ii AS (SELECT ie.qid, list(coalesce(lv.idx, 1) ORDER BY ie.pos) AS in_ids FROM ie LEFT JOIN lv ON ie.w = lv.word GROUP BY ie.qid),
oo AS (SELECT oe.qid, list(coalesce(lv.idx, 1) ORDER BY oe.pos) AS out_ids FROM oe LEFT JOIN lv ON oe.w = lv.word GROUP BY oe.qid)
SELECT qid, in_ids, out_ids FROM ii JOIN oo USING (qid)
""", ["outlinks", "inlinks"])
def link_encode(spark, sf):
    """Both link lists encoded with the shared link vocabulary."""
    voc = V._shared(spark, "link_vocab", sf, lambda: link_vocabulary(spark, sf), ("lineitem", "pages"))
    return lk.whole_lists(lk.encode_pages(kept_pages(spark, sf), voc))
