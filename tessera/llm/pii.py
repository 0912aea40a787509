"""Personal data replaced by surrogates.

Detected: e-mail addresses, passwords and tokens after their label, access
keys, IP addresses of both versions, MAC addresses, payment cards with a right
check digit, social security numbers, phone numbers, bank accounts (IBAN), and
persons named with a title.

A surrogate depends on a secret key and the entity's canonical form alone, so
one person, number or address has one surrogate in every document and in
every way it is written: digits stay digits, letters keep their script and
case, separators stay in place, cards and accounts pass their check digits,
phones keep their calling code and keys their opening, octets stay below 255, domains are replaced as a whole for all their addresses, and names
keep script and the gender that their title shows (a surname has the same
surrogate with and without a given name).

Collisions are checked over the distinct entities of the whole input: no two
entities of a kind share a surrogate and no surrogate is an entity that
occurs.  Entities that fail draw again until none fails; the first in order
keeps its draw, so results do not depend on the layout of the data.  Only
these exceptions, normally a handful, are joined back to their documents.

All is native expressions.  Texts are never shuffled unless there are
exceptions too many to broadcast, which Spark decides by their size.

Null texts stay null and empty ones empty; repeated rows and null ids are
replaced like others; texts of any length are read whole; empty tables give
empty tables; columns of the input with the name of an output column are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_columns, materialize

# Titles by the gender they show.
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "г-н"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Г-жа", "г-жа"),
          "u": ("Dr", "Prof")}


def _any(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


_ALL_TITLES = [t for ts in TITLES.values() for t in ts]
# in capitals only with a full stop (MS DOS is nobody); Sr after a name is a suffix
_TITLE = rf"(?:{_any(t for t in _ALL_TITLES if t != 'Sr')}\.?|(?<!\p{{Lu}}\p{{L}}{{0,20}},? )Sr\.?|{_any({t.upper() for t in _ALL_TITLES} - set(_ALL_TITLES))}\.)"
_NAME = r"\p{Lu}[\p{L}'’\-]+"
_SECRET_WORD = r"(?:password|passwd|passphrase|pwd|secret(?:[_\-](?:access[_\-])?key)?|token|(?:api|access|private)[_\-]?key)"
_LABEL = rf"(?i:(?:[a-z0-9]{{1,20}}[_\-]){{0,4}}{_SECRET_WORD})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEXES = r"[0-9A-Fa-f]{1,4}"
_EDGE = r"(?<![\p{L}\p{N}])"
_LABEL_PART = r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
# Openings of access keys.
_KEY_OPENINGS = r"(?:sk|pk)_(?:live|test)_|github_pat_|glpat-|xox[abprs]-|AIza|eyJ"
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@{_LABEL_PART}(?:\.{_LABEL_PART})+",
    "secret": _EDGE + _LABEL + r"[^\s\"']{6,}",
    "key": _EDGE + r"(?:AKIA[0-9A-Z]{16}|(?:(?:sk|pk)_(?:live|test)|(?:sk|pk|gh[opsur])[\-_])_?[A-Za-z0-9]{16,}|github_pat_[A-Za-z0-9_]{20,}"
                   r"|glpat-[A-Za-z0-9_\-]{16,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}"
                   r"|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})(?![\p{L}\p{N}])",
    "ip": rf"(?<![\d.vV])(?<!(?i:version|release) )(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:])(?:(?:{_HEXES}:){{7}}{_HEXES}|(?=[A-Fa-f:]{{0,39}}[0-9])(?:{_HEXES}:){{1,6}}(?::{_HEXES}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "mac": r"(?<![\p{L}\p{N}:\-])(?:(?:[0-9A-Fa-f]{2}:){5}|(?:[0-9A-Fa-f]{2}-){5})[0-9A-Fa-f]{2}(?![\p{L}\p{N}:\-])",
    "card": r"(?<![\d+])\d(?:[ \-]?\d){12,18}(?!\d)",
    "ssn": r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)|(?<!\d|\d )(?!000|666|9)\d{3} (?!00)\d{2} (?!0000)\d{4}(?! ?\d)",
    "phone": r"\+\d{1,3}(?:[ .\-]?\(\d{1,4}\))?(?:[ .\-]?\d{2,4}){2,5}(?!\d)|\(\d{3}\) ?\d{3}[\-. ]\d{4}(?!\d)|(?<!\d)\d{3}[\-.]\d{3}[\-.]\d{4}(?!\d)"
             r"|(?<!\d|\d[ .\-])(?:[2-9]\d{2} \d{3} \d{4}|0[1-9](?:(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4})|0[1-9]\d{1,3}[ \-]\d{6,8})(?![ .\-]?\d)",
    "iban": _EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "person": rf"{_EDGE}{_TITLE} {_NAME}(?: {_NAME})?",
}
PATTERN = "|".join(PATTERNS.values())
# A text without any of these characters, words and titles has no entity.
HINT = "[0-9@=:]"
HINT_WORDS = ("AKIA", "AIza", "eyJ", "xox", "github_pat_", "glpat-", "sk-", "sk_", "pk-", "pk_",
              *(f"gh{x}{sep}" for x in "opsur" for sep in "-_"), *_ALL_TITLES, *sorted({f"{t.upper()}." for t in _ALL_TITLES}))
# Letters surrogates are drawn from, by script.
DIGITS, LATIN, CYRILLIC, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "0123456789abcdef"
SYLLABLES = {"latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"], "cyrillic": [c + v for c in "бвгдзклмнпрст" for v in "аеиоу"]}
ENDINGS = {"latin": {"m": ["n", "r", "k", "s"], "f": ["a", "ia", "na", "la"], "u": ["e", "i", "ie", "y"], "": ["n", "r", "s", "t"]},
           "cyrillic": {"m": ["н", "р", "й", "к"], "f": ["а", "ия", "на", "ла"], "u": ["и", "о", "е", "ы"], "": ["ов", "ин", "ев", "ко"]}}
KEPT = {"key": 4, "phone": 1, "card": 1, "iban": 2}        # leading characters that say what it is, at least
# Calling codes of one and two digits; the others have three.  A trunk zero is kept like a code.
_CALLING = r"[017]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
OPENINGS = {"key": f"^(?:{_KEY_OPENINGS})", "phone": rf"^(?:{_CALLING}|\d{{3}})"}
BLOCK = 32                                                  # values from one digest


def _has(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def kind_of(m: Column) -> Column:
    """Kind of a match of PATTERN: the first pattern that fits it whole; null
    for a number as long as a card's whose check digit is wrong."""
    def of(kind: Column) -> Column:
        return F.when((kind != "card") | F.call_function("luhn_check", F.regexp_replace(m, "[^0-9]", "")), kind)
    return let(F.coalesce(*[F.when(_has(m, f"^(?:{p})$"), F.lit(k)) for k, p in PATTERNS.items()]), of)


def label_of(m: Column) -> Column:
    """The part before a secret's value."""
    return F.regexp_extract(m, "^" + _EDGE + "(" + _LABEL + ")", 1)


def gender_of(m: Column) -> Column:
    title = F.lower(F.regexp_replace(F.split_part(m, F.lit(" "), F.lit(1)), r"\.$", ""))
    return F.when(title.isin(*{t.lower() for t in TITLES["m"]}), "m").when(title.isin(*{t.lower() for t in TITLES["f"]}), "f").otherwise("u")


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often it is used
    (the variable of a lambda over an array of one)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def entities_of(m: Column, kind: Column) -> Column:
    """Array of (kind, canon) behind a match: one, or given name and surname."""
    value = (F.when(kind.isin("email", "ip6"), F.lower(m)).when(kind == "secret", F.substr(m, F.length(label_of(m)) + 1))
             .when(kind.isin("ip", "key"), m).otherwise(_plain(m)))
    names = F.split(m, " ")
    given = F.struct(F.concat(F.lit("given-"), gender_of(m)).alias("kind"), F.lower(F.get(names, F.lit(1))).alias("canon"))
    surname = F.struct(F.lit("surname").alias("kind"), F.lower(F.element_at(names, -1)).alias("canon"))
    person = F.when(F.size(names) > 2, F.array(given, surname)).otherwise(F.array(surname))
    return F.when(kind == "person", person).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("canon"))))


def _values(key: str, kind: Column, canon: Column, attempt: Column, n: Column) -> Column:
    """``n`` numbers below 65536 drawn for an entity."""
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    digest = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws(
        "\x1f", F.lit(key), kind, canon, attempt.cast("string"), b.cast("string")), 512)), "")
    return let(digest, lambda d: F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substr(d, i * 4 + 1, F.lit(4)), 16, 10).cast("int")))


def _letter(alphabet: str, value: Column) -> Column:
    return F.substr(F.lit(alphabet), value % len(alphabet) + 1, F.lit(1))


def _drawn(c: Column, value: Column) -> Column:
    """A character of the kind, case and script of ``c``; signs stay."""
    low = F.lower(c)
    new = (F.when(_has(c, r"^\p{N}"), _letter(DIGITS, value)).when(_has(c, r"^\p{IsCyrillic}"), _letter(CYRILLIC, value))
           .when(_has(c, r"^\p{L}"), _letter(LATIN, value)))
    return F.coalesce(F.when(c == low, new).otherwise(F.upper(new)), c)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _redrawn(text: Column, values: Column, keep: Column | int = 0) -> Column:
    """The characters of a text drawn anew, but for the first ``keep``."""
    return F.transform(_chars(text), lambda c, i: F.when(i < keep, c).otherwise(_drawn(c, F.get(values, i))))


def _check_digit(digits: Column) -> Column:
    """Digits with the last replaced by the one that makes the sum right."""
    n = F.size(digits)
    body = F.slice(digits, 1, n - 1)

    def weighed(d, i):
        doubled = d.cast("int") * 2
        return F.when((n - 1 - i) % 2 == 1, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(d.cast("int"))
    total = F.aggregate(F.transform(body, weighed), F.lit(0), lambda a, x: a + x)
    return F.concat(body, F.array(((F.lit(10) - total % 10) % 10).cast("string")))


def _valid_iban(new: Column) -> Column:
    """Country, two signs and account with the check digits that make the
    account's number, letters as 10 to 35, leave 1 when divided by 97."""
    def rest(acc, c):
        number = F.when(c.rlike("[0-9]"), acc * 10 + c.try_cast("int")).otherwise(acc * 100 + F.ascii(c) - 87)
        return number % 97
    moved = _chars(F.concat(F.substr(new, F.lit(5)), F.substr(new, F.lit(1), F.lit(2)), F.lit("00")))
    check = F.lit(98) - F.aggregate(moved, F.lit(0), rest)
    return F.concat(F.substr(new, F.lit(1), F.lit(2)), F.lpad(check.cast("string"), 2, "0"), F.substr(new, F.lit(5)))


def _name(kind: Column, canon: Column, values: Column, attempt: Column) -> Column:
    out = None
    for script in ("latin", "cyrillic"):
        parts, ends = F.array(*map(F.lit, SYLLABLES[script])), ENDINGS[script]
        # later draws are longer, so there is always room for one more name
        stem = F.array_join(F.transform(F.slice(values, 1, F.when(kind == "surname", 3).otherwise(2) + F.floor(attempt / 2).cast("int")),
                                        lambda v: F.get(parts, v % len(SYLLABLES[script]))), "")
        end = F.coalesce(*[F.when(kind == (f"given-{g}" if g else "surname"), F.get(F.array(*map(F.lit, ends[g])), F.element_at(values, -1) % 4))
                           for g in ends])
        named = F.concat(stem, end)
        out = named if out is None else F.when(_has(canon, r"\p{IsCyrillic}"), named).otherwise(out)
    return out


def surrogate_canon(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity, in canonical form."""
    def email(values: Column) -> Column:
        at = F.locate("@", canon)
        domain = F.substr(canon, at + 1)
        top = F.regexp_extract(domain, r"\.[^.]*$", 0)
        stem = F.substr(domain, F.lit(1), F.length(domain) - F.length(top))
        # the local part is drawn for the whole address, the domain for all addresses that have it
        host = let(_values(key, F.lit("domain"), stem, F.lit(0), F.greatest(F.length(stem), F.lit(1))),
                   lambda v: F.array_join(_redrawn(stem, v), ""))
        local = F.array_join(_redrawn(F.substr(canon, F.lit(1), F.greatest(at - 1, F.lit(0))), values), "")
        return F.concat(local, F.lit("@"), host, top)

    def by_kind(values: Column) -> Column:
        opening = F.coalesce(*[F.when(kind == k, F.length(F.regexp_extract(canon, o, 0))) for k, o in OPENINGS.items()], F.lit(0))
        keep = F.greatest(F.coalesce(*[F.when(kind == k, F.lit(n)) for k, n in KEPT.items()], F.lit(0)), opening)
        octets = F.array_join(F.transform(F.slice(values, 1, 4), lambda v: (v % 254 + 1).cast("string")), ".")
        hexes = F.array_join(F.transform(F.slice(values, 1, F.length(canon)), lambda v: _letter(HEX, v)), "")
        return (F.when(kind == "email", email(values)).when(kind == "ip", octets)
                .when(kind.startswith("given-") | (kind == "surname"), _name(kind, canon, values, attempt))
                .when(((kind == "secret") & _has(canon, "^[0-9a-f]+$")) | (kind == "mac"), hexes)
                .when(kind == "ip6", F.array_join(F.transform(_chars(canon), lambda c, i: F.when(c == ":", c).otherwise(_letter(HEX, F.get(values, i)))), ""))
                .when(kind == "iban", let(F.array_join(_redrawn(canon, values, keep), ""), _valid_iban))
                .when(kind == "card", let(_redrawn(canon, values, keep), lambda d: F.array_join(_check_digit(d), "")))
                .otherwise(F.array_join(_redrawn(canon, values, keep), "")))
    return let(_values(key, kind, canon, attempt, F.greatest(F.length(canon), F.lit(8) + attempt)), by_kind)


def _laid_out(m: Column, canon: Column) -> Column:
    """The letters and digits of ``canon`` in the places, and the case, of those of ``m``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))

    def laid(new):
        def step(acc, c):
            x = F.substr(new, acc["k"] + 1, F.lit(1))
            cased = F.when(c != F.lower(c), F.upper(x)).otherwise(F.lower(x))
            counts = _has(c, r"^[\p{L}\p{N}]")
            return F.struct(F.concat(acc["out"], F.when(counts, cased).otherwise(c)).alias("out"),
                            (acc["k"] + counts.cast("int")).alias("k"))
        return F.aggregate(_chars(m), start, step, lambda acc: acc["out"])
    return let(F.regexp_replace(canon, r"[^\p{L}\p{N}]", ""), laid)


def surrogate(m: Column, attempt_of, key: str) -> Column:
    """The surrogate of a match; ``attempt_of(kind, canon)`` is its draw."""
    def written(kind: Column, drawn: Column) -> Column:
        first, label = F.get(drawn, F.lit(0)), label_of(m)
        names = F.array_join(drawn, " ")
        person = F.concat(F.split_part(m, F.lit(" "), F.lit(1)), F.lit(" "), F.when(m == F.upper(m), F.upper(names)).otherwise(F.initcap(names)))
        return (F.when(kind.isNull(), m).when(kind == "person", person).when(kind == "ip", first)
                .when(kind == "secret", F.concat(label, _laid_out(F.substr(m, F.length(label) + 1), first)))
                .otherwise(_laid_out(m, first)))

    def of(kind: Column) -> Column:
        drawn = F.transform(entities_of(m, kind), lambda e: surrogate_canon(e["kind"], e["canon"], attempt_of(e["kind"], e["canon"]), key))
        return let(drawn, lambda d: written(kind, d))
    return let(kind_of(m), of)


def matches(text: Column) -> Column:
    """Matches in a text, in order; an empty array for none."""
    none = F.array().cast("array<string>")
    hint = _has(text, HINT)
    for word in HINT_WORDS:
        hint = hint | F.contains(text, F.lit(word))           # byte search, far cheaper than alternatives of a pattern
    return F.when(hint, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(none)


def repeated_draws(ents: DataFrame, key: str, rounds: int = 60) -> DataFrame | None:
    """(kind, canon, attempt) of the distinct entities whose first draw
    collides; None when none does."""
    table = ents.withColumn("attempt", F.lit(0))
    real = ents.select("kind", F.col("canon").alias("s")).withColumn("real", F.lit(True))
    for i in range(rounds):
        drawn = table.withColumn("s", surrogate_canon(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        first = drawn.groupBy("kind", "s").agg(F.min(F.struct("attempt", "canon")).alias("keeps"))
        tested = (drawn.join(first, ["kind", "s"]).join(real, ["kind", "s"], "left")
                  .withColumn("bad", F.col("real").isNotNull() | (F.col("keeps.canon") != F.col("canon"))))
        tested = materialize(tested.select("kind", "canon", "attempt", "bad"), "draws")
        if tested.filter("bad").isEmpty():
            return table.filter("attempt > 0") if i else None
        table = tested.select("kind", "canon", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"))
    raise RuntimeError("no free surrogates left for some kind of entity")


def pseudonymise(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``df`` with the entities of its texts replaced, plus n_entities and
    entity_kinds, one for each entity in the order of the text."""
    base = drop_columns(df, "n_entities", "entity_kinds")
    text = F.col(text_col).cast("string")
    found = base.withColumn("__m", F.coalesce(matches(text), F.array().cast("array<string>")))
    kinds = found.filter(F.size("__m") > 0).select(F.explode("__m").alias("m")).distinct().withColumn("kind", kind_of(F.col("m")))
    ents = materialize(kinds.filter("kind is not null").select(F.explode(entities_of(F.col("m"), F.col("kind"))).alias("e"))
                       .select("e.kind", "e.canon").distinct(), "entities")
    again = repeated_draws(ents, key)
    if again is None:
        attempt_of = lambda kind, canon: F.lit(0)
    else:
        again = materialize(again, "draws")
        name = lambda kind, canon: F.concat_ws("\x1f", kind, canon)
        digest = F.sha2(text, 256)
        hit = (found.filter(F.size("__m") > 0).select(digest.alias("__d"), F.explode(F.flatten(F.transform("__m", lambda m: entities_of(m, kind_of(m))))).alias("e"))
               .select("__d", "e.kind", "e.canon").distinct().join(again, ["kind", "canon"])
               .groupBy("__d").agg(F.map_from_entries(F.collect_list(F.struct(name(F.col("kind"), F.col("canon")), "attempt"))).alias("__a")))
        found = found.withColumn("__d", digest).join(materialize(hit, "redrawn"), "__d", "left")
        attempt_of = lambda kind, canon: F.coalesce(F.try_element_at(F.col("__a"), name(kind, canon)), F.lit(0))
    new = F.transform("__m", lambda m: surrogate(m, attempt_of, key))
    between = F.split(text, PATTERN, -1)
    replaced = F.array_join(F.transform(between, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("__s"), i), F.lit("")))), "")
    out = (found.withColumn("__s", new).withColumn("__t", F.when(F.size("__m") > 0, replaced).otherwise(text))
           .withColumn("__k", F.filter(F.transform("__m", kind_of), F.isnotnull)))
    return out.select(*[F.col("__t").alias(c) if c.lower() == text_col.lower() else c for c in base.columns],
                      F.size("__k").alias("n_entities"), F.col("__k").alias("entity_kinds"))
