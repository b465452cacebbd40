"""Cleaning and normalisation of text as column expressions.

Regular expressions use Java's syntax; ``SPACE`` is Unicode white space plus the separators
U+001C to U+001F.  NULL stays NULL everywhere.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from folium.functions import fixed

SPACE = r"[\s\x1c-\x1f]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(text: Column | str) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(col(text), rf"(?U)^{SPACE}+|{SPACE}+$", "")


def collapse_space(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(col(text), rf"(?U){SPACE}+", " "))


def replace_controls(text: Column | str) -> Column:
    """Control characters go (CR, VT and FF become line ends, tab a space), bullets become bullets."""
    deleted = "".join(chr(c) for c in [*range(0, 9), *range(14, 32), 127]) + "\ufffd"
    source = "\r\x0b\x0c\t" + "".join(fixed.BULLETS) + deleted
    return F.translate(col(text), source, "\n\n\n " + "".join(fixed.BULLETS.values()))


def any_of(patterns: list[str]) -> str:
    """One pattern for all.  An anchor that all share stands in front as well: else each alternative is tried at
    every character of a text that none fits."""
    joined = "|".join(f"(?:{p})" for p in patterns)
    return f"^(?:{joined})" if all(p.startswith("^") for p in patterns) else joined


def furniture_pattern(patterns: list[str] | None = None) -> str:
    return f"(?i)(?:{any_of(patterns or fixed.FURNITURE_LINES)})"


def clean(text: Column | str, min_line: int = 3, patterns: list[str] | None = None, collapse_newlines: bool = True) -> Column:
    """Lines stripped, short ones and page furniture dropped, white space collapsed.

    With ``collapse_newlines`` false the line structure stays, which paragraph logic downstream needs.
    """
    pattern = furniture_pattern(patterns)
    lines = F.transform(F.split(replace_controls(text), "\n"), strip)
    kept = F.filter(lines, lambda line: (F.char_length(line) >= min_line) & ~F.regexp_like(line, F.lit(pattern)))
    if not collapse_newlines:
        kept = F.transform(kept, collapse_space)
    joined = F.array_join(kept, "\n")
    return collapse_space(joined) if collapse_newlines else joined


def drop_duplicate_paragraphs(text: Column | str, separator: str = "\n\n", shortest: int = 15) -> Column:
    """The first of paragraphs that are equal without regard to case and white space; short ones all stay."""
    parts = F.split(col(text), re.escape(separator))
    keys = F.transform(parts, lambda p: F.when(F.char_length(strip(p)) >= shortest, collapse_space(F.lower(p))))
    # Sorted by key and place, the first of each key is where the key changes: no search for every paragraph.
    placed = F.transform(keys, lambda k, i: F.struct(k.alias("key"), i.alias("at")))

    def firsts(ordered: Column) -> Column:
        new = lambda z, i: z["key"].isNull() | (i == 0) | ~z["key"].eqNullSafe(F.get(ordered, i - 1)["key"])
        return F.array_sort(F.transform(F.filter(ordered, new), lambda z: z["at"]))

    kept = lambda p: F.transform(let(F.array_sort(placed), firsts), lambda i: F.get(p, i))
    return F.array_join(let(parts, kept), separator)


def replace_patterns(text: Column | str, patterns: list[str], replacements: list[str]) -> Column:
    """Regular expressions replaced one after another; back references may be written as ``\\1``."""
    if len(patterns) != len(replacements):
        raise ValueError("as many replacements as patterns are needed")
    pairs = zip(patterns, (re.sub(r"\\(\d)", r"$\1", r) for r in replacements), strict=True)
    return reduce(lambda acc, pr: F.regexp_replace(acc, pr[0], pr[1]), pairs, col(text))


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t)).astype(object)


def display(text: Column | str, compose: bool = True) -> Column:
    """Typographic characters as plain ones; accented letters stay."""
    out = nfc(col(text)) if compose else col(text)
    for sequence, plain in fixed.QUESTION_SEQUENCES:
        out = F.replace(out, F.lit(sequence), F.lit(plain))
    out = F.regexp_replace(out, "\u2026\\s*\\?", "...?")
    single = {a: b for a, b in fixed.DISPLAY.items() if len(b) == 1 and a != b}
    gone = "".join(a for a, b in fixed.DISPLAY.items() if not b)
    out = F.translate(out, "".join(single) + gone, "".join(single.values()))
    for a, b in fixed.DISPLAY.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, fixed.QUESTION_LIKE, "?")
    out = F.regexp_replace(F.regexp_replace(out, r"[^\x00-\x7F]+\?", "?"), r"\?[^\x00-\x7F]+", "?")
    return F.regexp_replace(out, fixed.ZERO_WIDTH, "")


@F.pandas_udf(StringType())
def _unaccent(texts: pd.Series) -> pd.Series:
    def plain(t: str | None) -> str | None:
        if t is None:
            return None
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return "".join(c if ord(c) < 128 else "?" for c in t)

    return texts.map(plain).astype(object)


def to_ascii(text: Column | str) -> Column:
    """Display form with accents taken off and anything else beyond ASCII as a question mark."""
    return _unaccent(display(text))


def safe_filename(name: Column | str) -> Column:
    """ASCII, spaces as underscores, no characters that file systems refuse; never empty."""
    plain = F.regexp_replace(F.replace(to_ascii(name), F.lit(" "), F.lit("_")), r'[\\/:*?"<>|]', "")
    return F.when(F.coalesce(plain, F.lit("")) == "", "unnamed").otherwise(plain)


def is_ascii(text: Column | str) -> Column:
    return ~F.regexp_like(col(text), F.lit(r"[^\x00-\x7F]"))


def problem_characters(text: Column | str) -> Column:
    """Distinct non-ASCII characters other than accented Latin letters, question-like ones first."""
    found = F.array_distinct(F.regexp_extract_all(col(text), F.lit(r"([^\x00-\x7F\u00C0-\u00FF])"), F.lit(1)))
    question = lambda c: F.regexp_like(c, F.lit("[\u00bf\uff1f\u2047\u203d\u2048\u2049\u037e\u061f\u2370\u0294\u0241\ufffd]"))
    return F.concat(F.filter(found, question), F.filter(found, lambda c: ~question(c)))


def escape_non_ascii(text: Column | str) -> Column:
    """Characters beyond ASCII as ``\\u`` and at least four hexadecimal digits."""
    characters = F.filter(F.split(col(text), ""), lambda c: c != "")
    code = lambda c: F.lower(F.hex(F.encode(c, "UTF-32")))
    digits = lambda c: F.when(F.substring(code(c), 1, 4) == "0000", F.substring(code(c), 5, 4)).otherwise(F.regexp_replace(code(c), "^0+", ""))
    return F.array_join(F.transform(characters, lambda c: F.when(is_ascii(c), c).otherwise(F.concat(F.lit("\\u"), digits(c)))), "")


@F.pandas_udf(StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """``\\u`` escapes decoded; other characters stay as they are."""
    one = lambda m: chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else m[0]
    return texts.map(lambda t: None if t is None else re.sub(r"\\u([0-9a-fA-F]{4,6})", one, t)).astype(object)


def first_sentences(text: Column | str, longest: int = 150) -> Column:
    """Leading sentences (by full stops) while they stay within ``longest`` characters."""
    parts = F.transform(F.filter(F.split(col(text), r"\."), lambda s: strip(s) != ""), lambda s: F.concat(strip(s), F.lit(".")))
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("open"))

    def add(acc: Column, s: Column) -> Column:
        longer = F.when(acc["text"] == "", s).otherwise(F.concat(acc["text"], F.lit(" "), s))
        fits = acc["open"] & (F.char_length(longer) <= longest)
        return F.struct(F.when(fits, longer).otherwise(acc["text"]).alias("text"), fits.alias("open"))

    return F.aggregate(parts, start, add, lambda acc: acc["text"])


def word_count(text: Column | str) -> Column:
    """Tokens between white space."""
    body = strip(text)
    return F.when(body == "", F.lit(0)).otherwise(F.size(F.split(body, rf"(?U){SPACE}+"))).cast("long")


def slices(text: Column | str, size: int) -> Column:
    """Consecutive slices of a fixed length; none of an empty text."""
    body = col(text)
    count = F.ceil(F.char_length(body) / F.lit(size)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(body, i * size + 1, F.lit(size)))
    return F.when(count > 0, parts).when(count == 0, F.array().cast("array<string>"))


def count_of(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: expressions inside lambdas are otherwise computed at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def best_of(scores: list[tuple[str, Column]]) -> Column:
    """struct<score: double, at: int, name: string> of the greatest score; the first declared wins ties."""
    return F.array_max(F.array(*[
        F.struct(s.cast("double").alias("score"), F.lit(-i).alias("at"), F.lit(n).alias("name")) for i, (n, s) in enumerate(scores)
    ]))
