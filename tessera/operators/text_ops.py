"""DataFrame-level text operators built on the column expressions of
``tessera.functions.text`` (T9-T11, T14, T18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lookup import lookup_tokens

# Heading extractors: HTML headings and wiki "== Heading ==" lines.
HTML_HEADING_RE = r"<h[1-6][^>]*>([^<]*)</h[1-6]>"
# (group 2; the text may hold "=", and comments may follow the closing marks)
WIKI_HEADING_RE = r"(?m)^(={1,6})([^\n]*?)\1[ \t]*(?:<!--[^\n]*?-->[ \t]*)*$"


def section_text(text, html: bool = True):
    """All heading texts of an article joined by one space."""
    pat, group = (HTML_HEADING_RE, 1) if html else (WIKI_HEADING_RE, 2)
    return F.array_join(F.regexp_extract_all(text, F.lit(pat), group), " ")


def word_counts(df: DataFrame, toks_col: str = "toks", by=()) -> DataFrame:
    """A2 core: occurrences per word (optionally per ``by`` columns); the
    partial aggregate runs map-side so hot words never pile up."""
    return (df.select(*by, F.explode(toks_col).alias("word"))
            .groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n")))


def drop_rare_words(df: DataFrame, id_col: str, toks_col: str = "toks", min_count: int = 6,
                    out_col: str = "toks", by=(), frequent: DataFrame | None = None) -> DataFrame:
    """Drop tokens whose corpus count is below ``min_count`` (the
    reference drops counts <= 5), keeping token order and articles that end
    up empty.  Other columns of ``df`` are kept; ids are unique."""
    counts = word_counts(df, toks_col, by).filter(F.col("n") >= min_count)
    extra = [c for c in df.columns if c not in (id_col, toks_col)]
    found = lookup_tokens(df, id_col, toks_col, counts, None, by, "word", extra, frequent)
    kept = F.transform(F.filter("__s", lambda s: s["value"].isNotNull()), lambda s: s["word"])
    return found.select(id_col, *extra, kept.alias(out_col))
