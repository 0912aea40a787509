"""DuckDB SQL for the oracle, generated from the same fixed values the Spark
expressions use (patterns, digit names, stop words), so both engines run the
same rules."""

from __future__ import annotations

from tessera.functions.text import (DEFAULT_LANG, LEGACY_MARKUP_PATTERNS, MARKUP_PATTERNS, PROFILES,
                                    WHITE_SPACE, stopwords_for)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def qlist(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]::VARCHAR[]"


def by_lang(lang: str, build, langs=tuple(PROFILES)) -> str:
    parts = [f"WHEN {lang} = {q(c)} THEN {build(PROFILES[c])}" for c in langs]
    return "CASE " + " ".join(parts) + " END"


def clean_markup(expr: str, legacy: bool = False) -> str:
    out = f"lower({expr})"
    for p in (LEGACY_MARKUP_PATTERNS if legacy else MARKUP_PATTERNS):
        out = f"regexp_replace({out}, {q(p)}, ' ', 'g')"
    return out


def keep_alphabet(expr: str, lang: str, langs=tuple(PROFILES)) -> str:
    def build(p):
        out = f"regexp_replace({expr}, {q(p.alphabet_pattern)}, ' ', 'g')"
        for extra in p.extra_patterns:
            out = f"regexp_replace({out}, {q(extra)}, ' ', 'g')"
        return out
    return by_lang(lang, build, langs)


def drop_single_letters(expr: str, lang: str, langs=tuple(PROFILES)) -> str:
    toks = f"string_split_regex(trim({expr}), ' +')"

    def build(p):
        if not p.drop_single_letters:
            return f"array_to_string({toks}, ' ')"
        return (f"array_to_string(list_filter({toks}, lambda t: NOT (length(t) = 1 AND "
                f"NOT (t BETWEEN '0' AND '9'))), ' ')")
    return by_lang(lang, build, langs)


def digits_to_words(expr: str, lang: str | None, langs=tuple(PROFILES)) -> str:
    def build(p):
        out = f"trim({expr}, {q(WHITE_SPACE)})"
        for ch, word in p.digit_words:
            out = f"replace({out}, {q(ch)}, {q(word)})"
        return out
    if lang is None:
        return build(PROFILES[DEFAULT_LANG])
    return by_lang(lang, build, langs)


def split_tokens(expr: str) -> str:
    return f"list_filter(string_split_regex({expr}, ' +'), lambda t: trim(t) <> '')"


def remove_stopwords(expr: str, lang: str, langs=tuple(PROFILES)) -> str:
    def build(p):
        words = stopwords_for(p.code)
        if not words:
            return expr
        return f"list_filter({expr}, lambda t: NOT list_contains({qlist(words)}, t))"
    return by_lang(lang, build, langs)


def normalise_ctes(src: str, id_col: str, text_col: str, lang_col: str, keep: list[str],
                   out: str = "tokens", prefix: str = "nz", stopwords: bool = True,
                   legacy: bool = False) -> tuple[str, str]:
    """Return (cte_text, final_cte_name); the final CTE has keep + out."""
    kept = ", ".join(keep)
    lang = lang_col if not legacy else "'en'"
    c = []
    c.append(f"{prefix}0 AS (SELECT {kept}, {lang} AS __lang, {clean_markup(text_col, legacy)} AS m FROM {src})")
    c.append(f"{prefix}1 AS (SELECT {kept}, __lang, {keep_alphabet('m', '__lang')} AS a FROM {prefix}0)")
    c.append(f"{prefix}2 AS (SELECT {kept}, __lang, {drop_single_letters('a', '__lang')} AS s FROM {prefix}1)")
    c.append(f"{prefix}3 AS (SELECT {kept}, __lang, {digits_to_words('s', '__lang')} AS d FROM {prefix}2)")
    c.append(f"{prefix}4 AS (SELECT {kept}, __lang, {split_tokens('d')} AS k FROM {prefix}3)")
    final = remove_stopwords('k', '__lang') if stopwords else 'k'
    c.append(f"{prefix}5 AS (SELECT {kept}, {final} AS {out} FROM {prefix}4)")
    return ",\n".join(c), f"{prefix}5"
