"""Text normalisation as Spark column expressions.

Canonical order: lower -> markup patterns -> language alphabet -> drop single
letters -> digits to words -> split on spaces -> drop blanks -> drop stop
words.  Everything is a native expression (``regexp_replace``, ``split``,
higher-order ``filter``), so a whole corpus is normalised in one projection
inside whole-stage codegen, with no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical tokens).
# Markup patterns, applied in this order, each match replaced by one space.
# Written in Java regex syntax; '.' is spelled '[^\n]' so that Java and RE2
# agree on '\r', and the URL alternation of single characters is spelled as
# the equivalent character class.
# ---------------------------------------------------------------------------
MARKUP_PATTERNS = [
    r"\[\[category:[^\n]*?\]\]",
    r"\[\[категория:[^\n]*?\]\]",
    r"\[\[श्रेणी:[^\n]*?\]\]",
    r"\{\{[^\n]*?\}\}",
    "&amp;",
    "&lt;",
    "&gt;",
    r"<ref[^<]*</ref>",
    r"<[^>]*>",
    r"\|left",
    r"\|\d+px",
    r"(https|http)?://[\w./?=&%]*\b",
    r"\|thumb",
    r"\|right",
    r"\[\[image:[^\[\]]*",
    r"\[\[category:([^|\]]*)[^\]]*\]\]",
    r"\[\[[a-z\-]*:[^\]]*\]\]",
    r"\[",
    r"\]",
    r"\{[^\}]*\}",
    r"\n",
    " +",
]

# The earlier English-only variant (greedy template pattern,
# bare category prefix, space collapse applied last by the caller).
LEGACY_MARKUP_PATTERNS = [
    r"\{\{[^\n]*\}\}",
    "&amp;",
    "&lt;",
    "&gt;",
    r"<ref[^<]*</ref>",
    r"<[^>]*>",
    r"\|left",
    r"\|\d+px",
    r"\[\[category:",
    r"(https|http)?://[\w./?=&%]*\b",
    r"\|thumb",
    r"\|right",
    r"\[\[image:[^\[\]]*",
    r"\[\[category:([^|\]]*)[^\]]*\]\]",
    r"\[\[[a-z\-]*:[^\]]*\]\]",
    r"\[",
    r"\]",
    r"\{[^\}]*\}",
    r"\n",
]

# Patterns that use \d / \w: Python's classes are Unicode, Java's need (?U).
UNICODE_CLASS_PATTERNS = {r"\|\d+px", r"(https|http)?://[\w./?=&%]*\b"}

# Digit names, each with its leading space.
DIGITS_EN = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
DIGITS_RU = ["ноль", "один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять"]
DIGITS_HI = ["शून्य", "एक", "दो", "तीन", "चार", "पांच", "छह", "सात", "आठ", "नौ"]
DEVANAGARI_DIGITS = "०१२३४५६७८९"
# Our own profiles for the Latin-script test languages.
DIGITS_FR = ["zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"]
DIGITS_DE = ["null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"]
DIGITS_ES = ["cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"]


@dataclass(frozen=True)
class Profile:
    """Per-language rules: kept alphabet, extra removals, digit names,
    single-letter removal and the Spark stop-word list name."""
    code: str
    letters: str                      # regex class body of kept letters
    digit_words: tuple                # (char, replacement) pairs
    drop_single_letters: bool = True
    extra_patterns: tuple = ()
    stopword_list: str | None = None
    extra_stopwords: tuple = field(default_factory=tuple)

    @property
    def alphabet_pattern(self) -> str:
        return f"[^{self.letters}0-9 ]"


def _digit_pairs(words, chars="0123456789"):
    return tuple((c, " " + w) for c, w in zip(chars, words))


PROFILES: dict[str, Profile] = {
    "en": Profile("en", "a-zA-Z", _digit_pairs(DIGITS_EN), True, (), "english"),
    "ru": Profile("ru", "а-яА-Я", _digit_pairs(DIGITS_RU), True, (), "russian"),
    "hi": Profile("hi", "ऀ-ॿ", _digit_pairs(DIGITS_HI) + _digit_pairs(DIGITS_HI, DEVANAGARI_DIGITS),
                  False, ("।",), None),
    "fr": Profile("fr", "a-zA-Zàâæçéèêëîïôœùûüÿ", _digit_pairs(DIGITS_FR), True, (), "french"),
    "de": Profile("de", "a-zA-Zäöüß", _digit_pairs(DIGITS_DE), True, (), "german"),
    "es": Profile("es", "a-zA-Záéíñóúü", _digit_pairs(DIGITS_ES), True, (), "spanish"),
}
DEFAULT_LANG = "en"
# White space as Python's str.strip sees it.
WHITE_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def profile(lang: str) -> Profile:
    """The profile of a language; an unknown code is an error, never English."""
    if lang not in PROFILES:
        raise ValueError(f"no profile for language {lang!r}; known: {', '.join(PROFILES)}")
    return PROFILES[lang]


@lru_cache(maxsize=None)
def spark_stopwords(name: str | None) -> tuple:
    """Spark's default stop-word list (the same list
    ``StopWordsRemover.loadDefaultStopWords`` returns), shipped as package
    data so neither a JVM nor a Spark jar is needed to build literals or SQL."""
    if not name:
        return ()
    raw = (resources.files("tessera.functions") / "stopwords" / f"{name}.txt").read_text("utf-8")
    return tuple(w for w in raw.split("\n") if w.strip() != "")


def stopwords_for(lang: str) -> tuple:
    p = profile(lang)
    return spark_stopwords(p.stopword_list) + tuple(p.extra_stopwords)


def java_pattern(p: str) -> str:
    return "(?U)" + p if p in UNICODE_CLASS_PATTERNS else p


def java_class(letters: str) -> str:
    """The body of a character class with its ranges inside Latin-1 written out
    letter by letter.  Java looks such letters up in one table; it asks every
    range by a call, a dozen times slower on whole texts."""
    def written_out(m):
        first, last = ord(m[1]), ord(m[2])
        return "".join(map(chr, range(first, last + 1))) if last < 256 else m[0]
    return re.sub(r"([^\W_])-([^\W_])", written_out, letters)


# ---------------------------------------------------------------------------
# Column builders
# ---------------------------------------------------------------------------

def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_markup(text, legacy: bool = False) -> Column:
    """T1+T2 as one nested column expression: lower-case, then the ordered
    markup removals (simple form; ``clean_markup_df`` is the fast form)."""
    out = F.lower(_col(text).cast("string"))
    for p in (LEGACY_MARKUP_PATTERNS if legacy else MARKUP_PATTERNS):
        out = F.regexp_replace(out, java_pattern(p), " ")
    return out


# Characters at least one of which every markup pattern needs, except the
# two below that apply to any text.
MARKUP_TRIGGER = r"[\[\]{&<|:]"
_ALWAYS = {r"\n", " +"}

# Patterns that are plain strings: replaced with a substring search instead
# of a regex scan (identical result).
_LITERAL_FORM = {"&amp;": "&amp;", "&lt;": "&lt;", "&gt;": "&gt;", r"\|left": "|left",
                 r"\|thumb": "|thumb", r"\|right": "|right", r"\[": "[", r"\]": "]",
                 r"\n": "\n"}
def clean_markup_df(df, text_col: str, out_col: str, legacy: bool = False):
    """T1+T2 as one projection.  Literal patterns use plain substring
    replacement instead of a regex scan (identical result).  The chain is a
    single nested expression on purpose: one projection per pattern would
    make Catalyst's constraint inference over the aliases blow up."""
    low = F.col(out_col)
    df = df.withColumn(out_col, F.lower(F.col(text_col).cast("string")))
    patterns = LEGACY_MARKUP_PATTERNS if legacy else MARKUP_PATTERNS
    full, plain = low, low
    for p in patterns:
        if p in _LITERAL_FORM:
            full = F.replace(full, F.lit(_LITERAL_FORM[p]), F.lit(" "))
        else:
            full = F.regexp_replace(full, java_pattern(p), " ")
        if p in _ALWAYS:
            plain = F.replace(plain, F.lit("\n"), F.lit(" ")) if p == r"\n" else F.regexp_replace(plain, p, " ")
    # Every pattern except the newline and space-run ones needs one of the
    # characters below; text without any of them skips those scans (same
    # result, one cheap check instead of ~20 regex passes).
    return df.withColumn(out_col, F.when(F.col(out_col).rlike(MARKUP_TRIGGER), full).otherwise(plain))


def _by_lang(lang, build, langs=None) -> Column:
    """CASE lang WHEN .. THEN build(profile) ..; a row in a language that is
    not listed (default: every profile) fails the job."""
    lang = _col(lang)
    expr = F
    for code in langs or PROFILES:
        expr = expr.when(lang == code, build(profile(code)))
    return expr.otherwise(F.raise_error(F.concat(F.lit("no profile for language "), F.coalesce(lang, F.lit("null")))))


def keep_alphabet(text, lang, langs=None) -> Column:
    """T3 (+ the Hindi full stop): everything outside the language alphabet,
    digits and space becomes a space."""
    def build(p: Profile):
        # a run of foreign characters becomes one space: same tokens as one
        # space per character, fewer replacements
        out = F.regexp_replace(_col(text), f"[^{java_class(p.letters + '0-9 ')}]+", " ")
        for extra in p.extra_patterns:
            out = F.regexp_replace(out, extra, " ")
        return out
    return _by_lang(lang, build, langs)


def _is_single_letter(t: Column) -> Column:
    return (F.length(t) == 1) & ~t.between("0", "9")


def drop_single_letters(text, lang, langs=None) -> Column:
    """T4 as a token filter: after T3 only letters, digits and spaces remain,
    so a letter between word boundaries is exactly a one-letter token."""
    toks = F.split(F.trim(_col(text)), " +")

    def build(p: Profile):
        if not p.drop_single_letters:
            return F.array_join(toks, " ")
        return F.array_join(F.filter(toks, lambda t: ~_is_single_letter(t)), " ")
    return _by_lang(lang, build, langs)


def digits_to_words(text, lang=None, langs=None) -> Column:
    """T5: every digit becomes ' <name>' (leading space kept, so '23' gives
    ' two three' and '2nd' gives ' twond'); input stripped first."""
    def build(p: Profile):
        out = F.btrim(_col(text), F.lit(WHITE_SPACE))
        for ch, word in p.digit_words:
            out = F.replace(out, F.lit(ch), F.lit(word))
        return out
    if lang is None:
        return build(PROFILES[DEFAULT_LANG])
    return _by_lang(lang, build, langs)


def split_tokens(text) -> Column:
    """T6+T8: split on runs of spaces, drop blank tokens."""
    return F.filter(F.split(_col(text), " +"), lambda t: F.trim(t) != "")


def stopword_array(lang_code: str) -> Column:
    words = stopwords_for(lang_code)
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def remove_stopwords(tokens, lang, langs=None, lists: dict | None = None) -> Column:
    """Exact membership test against a per-language literal list (order
    and duplicates of the remaining tokens kept, unlike array_except)."""
    def build(p: Profile):
        words = (lists or {}).get(p.code, stopwords_for(p.code))
        if not words:
            return _col(tokens)
        # IN over literals becomes a hash-set lookup (InSet) per token
        return F.filter(_col(tokens), lambda t: ~t.isin(list(words)))
    return _by_lang(lang, build, langs)


# Fixed value: the ASCII punctuation characters (Python's string.punctuation).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def drop_punctuation(tokens, substring_test: bool = False) -> Column:
    """Drop punctuation tokens -- set membership of single punctuation
    characters, or (the older variant) any token that is a substring of the
    punctuation string.  A no-op after the alphabet filter; kept for
    un-normalised input."""
    if substring_test:
        return F.filter(_col(tokens), lambda t: F.instr(F.lit(PUNCTUATION), t) == 0)
    return F.filter(_col(tokens), lambda t: ~t.isin(list(PUNCTUATION)))


def drop_short_tokens(tokens, min_len: int = 3) -> Column:
    """T10."""
    return F.filter(_col(tokens), lambda t: F.length(t) >= min_len)


def truncate_tokens(tokens, n: int | None) -> Column:
    """First n tokens, None keeps all."""
    return _col(tokens) if n is None else F.slice(_col(tokens), 1, n)


def normalise(df, text_col: str = "text", lang_col: str = "lang", out_col: str = "tokens", *,
              stopwords: bool = True, legacy: bool = False, langs=None,
              keep_cols=None, stop_lists: dict | None = None):
    """The whole pipeline as one DataFrame operator (lazy, one projection
    chain, no shuffle; works on streaming frames too).

    Each stage is materialised as its own column so that the per-language
    CASE branches reference a column rather than re-inlining the previous
    stage (Catalyst does not collapse a non-cheap expression that is used
    more than once, so every regex runs exactly once per row)."""
    t = "__tsr_"
    if legacy:
        df = df.withColumn(t + "lang", F.lit("en"))
        lang_col_eff, langs = t + "lang", ("en",)
    else:
        lang_col_eff = lang_col
    lists = tuple(sorted((k, tuple(v)) for k, v in (stop_lists or {}).items()))
    exprs = _stage_exprs(df.sparkSession, lang_col_eff, tuple(langs or PROFILES), stopwords, lists)
    df = clean_markup_df(df, text_col, t + "m", legacy=legacy)
    df = df.withColumn(t + "a", exprs["a"])
    df = df.withColumn(t + "s", exprs["s"])
    df = df.withColumn(t + "d", exprs["d"])
    df = df.withColumn(t + "k", exprs["k"])
    df = df.withColumn(out_col, exprs["out"])
    tmp = [c for c in df.columns if c.startswith(t)]
    df = df.drop(*tmp)
    if keep_cols is not None:
        df = df.select(*keep_cols, out_col)
    return df


_EXPR_CACHE: dict = {}


def _stage_exprs(spark, lang_col: str, langs: tuple, stopwords: bool, lists: tuple = ()) -> dict:
    """The per-language stage expressions, built once per session: they are
    unresolved column expressions (reusable across DataFrames), and building
    the literal-heavy CASE trees costs more driver time than planning."""
    key = (spark.sparkContext.applicationId, lang_col, langs, stopwords, lists)
    if key not in _EXPR_CACHE:
        t = "__tsr_"
        _EXPR_CACHE[key] = {
            "a": keep_alphabet(t + "m", lang_col, langs),
            "s": drop_single_letters(t + "a", lang_col, langs),
            "d": digits_to_words(t + "s", lang_col, langs),
            "k": split_tokens(t + "d"),
            "out": (remove_stopwords(t + "k", lang_col, langs, dict(lists) or None) if stopwords
                    else F.col(t + "k")),
        }
    return _EXPR_CACHE[key]
