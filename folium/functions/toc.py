"""Tables of contents: detection in text, levels, outlines, language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from folium.functions import fixed
from folium.functions.text import any_of, best_of, let

ENTRY = "array<struct<title:string,page:int,level:int,text:string,section:string>>"

# Entry forms in the order they are tried, with the groups of section, title and page (0 is absent).
FORMS = [
    (r"^(.+?)[\.\-_]{2,}\s*(\d+)\s*$", 0, 1, 2),
    (r"^(\s*(?:\d+[\.\-])*\d+[\.\-]?)\s+(.+?)\s+(\d+)\s*$", 1, 2, 3),
    (r"^(\s*(?:[IVX]+|[A-Z])[\.\-])\s+(.+?)\s+(\d+)\s*$", 1, 2, 3),
    (r"^(\s*[\[\(](?:\d+|[A-Z]|[IVX]+)[\]\)])\s+(.+?)\s+(\d+)\s*$", 1, 2, 3),
    (r"^(.+?)\s+(?:[Pp]age|[Pp]ágina|[Pp]agina|[Ss]eite|[Pp]\.?|страница|стр\.|strona|str\.|σελίδα|σελ\.|oldal|sivu|s\.|sida|strana|pagină|pag\.)\s+(\d+)\s*$", 0, 1, 2),
    (r"^(\s+|[»•◦▪‣◘○●·]+\s+)(.+?)\s+(\d+)\s*$", 0, 2, 3),
    (r"^(.+?)\s+(\d+)\s*$", 0, 1, 2),
]


def is_toc_title(line: Column | str) -> Column:
    return F.regexp_like(F.trim(line), F.lit(any_of(fixed.TOC_TITLES)))


def is_toc_entry(line: Column | str) -> Column:
    return F.regexp_like(line, F.lit(any_of(fixed.TOC_ENTRIES)))


def entry_parts(line: Column) -> Column:
    """struct<section, title, page> by the first form that fits; null if none does."""
    def one(pattern: str, section: int, title: int, page: int) -> Column:
        part = lambda g: F.regexp_extract(line, pattern, g)
        struct = F.struct(
            (F.nullif(F.trim(part(section)), F.lit("")) if section else F.lit(None).cast("string")).alias("section"),
            F.trim(part(title)).alias("title"), F.expr("CAST(NULL AS INT)").alias("none"), part(page).try_cast("int").alias("page"),
        )
        direct = pattern == FORMS[-1][0]
        fits = F.regexp_like(line, F.lit(pattern))
        if direct:
            fits = fits & part(page).try_cast("int").between(1, 5000) & F.char_length(line).between(5, 200)
        return F.when(fits, struct.dropFields("none"))

    return F.coalesce(*[one(*form) for form in FORMS])


def fix_levels(levels: list[tuple[str | None, int]]) -> list[int]:
    """Levels from section depth (or the indent given), with no jump of more than one."""
    out: list[int] = []
    for section, indent in levels:
        level = min(3, section.rstrip(".-").count(".") + section.rstrip(".-").count("-")) if section and section[0].isdigit() else indent
        if out and level > out[-1] + 1:
            level = out[-1] + 1
        out.append(level)
    return out


def entry_levels(entries: Column) -> Column:
    """Entries with levels by section depth and no jump of more than one (the fixed previous level counts)."""
    start = F.array().cast(ENTRY)

    def step(acc: Column, e: Column) -> Column:
        numbered = F.regexp_like(F.coalesce(e["section"], F.lit("")), F.lit(r"^\d"))
        depth = F.regexp_count(F.regexp_replace(e["section"], r"[.\-]+$", ""), F.lit(r"[.\-]"))
        level = F.when(numbered, F.least(depth, F.lit(3))).otherwise(e["level"])
        last = F.try_element_at(acc, F.lit(-1))["level"]
        fixed_level = F.when(last.isNotNull() & (level > last + 1), last + 1).otherwise(level)
        new = F.struct(e["title"].alias("title"), e["page"].alias("page"), fixed_level.cast("int").alias("level"), e["text"].alias("text"), e["section"].alias("section"))
        return F.concat(acc, F.array(new))

    return F.aggregate(entries, start, step)


def outline_toc(outline: Column) -> Column:
    """Entries from a document outline (structs of level, title, page)."""
    return F.transform(outline, lambda o: F.struct(
        o["title"].alias("title"), o["page"].try_cast("int").alias("page"), F.greatest(o["level"].try_cast("int") - 1, F.lit(0)).alias("level"),
        o["title"].alias("text"), F.lit(None).cast("string").alias("section"),
    ))


def toc_language(title: Column, entries: Column) -> Column:
    """The language with the most of its words in the title and ten entries, at least two; the first declared on ties."""
    text = F.lower(F.concat_ws(" ", title, F.array_join(F.transform(F.slice(entries, 1, 10), lambda e: F.coalesce(e["title"], e["text"])), " ")))
    hits = lambda t, words: sum((F.contains(t, F.lit(w)).cast("int") for w in words[1:]), F.contains(t, F.lit(words[0])).cast("int"))
    best = let(text, lambda t: best_of([(lang, hits(t, words)) for lang, words in fixed.TOC_LANGUAGES.items()]))
    return let(best, lambda b: F.when(b["score"] >= 2, b["name"]).otherwise("unknown"))


_TITLE = re.compile("|".join(f"(?:{p})" for p in fixed.TOC_TITLES), re.IGNORECASE)
_ENTRY = re.compile("|".join(f"(?:{p})" for p in fixed.TOC_ENTRIES))
_LOOSE = ("contents", "index", "indice", "sommario", "índice", "sommaire", "inhalt", "sumário", "obsah", "cuprins")


def _ends_in_number(line: str) -> bool:
    """White space, digits and white space at the end, as every entry form has it: others need not be tried, each a search through the line."""
    last = line.rsplit(None, 1)[1:]
    return bool(last) and last[0].isdecimal()


def find_toc(text: str | None, least: int = 3, most: int = 150) -> tuple[str, list[str]] | None:
    """Title and entry lines of the table of contents in the first 15 000 characters.

    A title among the first 30 blocks; else one of its words in a short block among the first 50;
    else three of ten blocks that end in a number with at most one that does not.  Then up to forty
    blocks of entries; two blocks in a row that are none end it.
    """
    blocks = [b.strip("\n") for b in re.split(r"\n\s*\n", (text or "")[:15000])]
    at, title = None, ""
    for i, b in enumerate(blocks[:30]):
        head = b.strip().split("\n")[0].strip()
        if _TITLE.match(head):
            at, title = i, head
            break
    if at is None:
        for i, b in enumerate(blocks[:50]):
            if 3 <= len(b.strip()) <= 100 and any(w in b.lower() for w in _LOOSE):
                at, title = i, b.strip()
                break
    if at is None:
        like = [bool(re.search(r"\d+\s*$", b)) and len(b.strip()) >= 5 for b in blocks]
        at = next((i - 1 for i in range(len(blocks)) if like[i] and sum(like[i : i + 4]) >= 3), None)
    if at is None:
        return None
    lines, misses = [], 0
    rest = blocks[max(at, 0)].split("\n")[1:] if at >= 0 and title else []
    for line in [*rest, *[x for b in blocks[at + 1 : at + 41] for x in b.split("\n")]]:
        if not line.strip():
            continue
        if _ends_in_number(line) and _ENTRY.match(line):
            lines.append(line)
            misses = 0
        else:
            misses += 1
            if misses >= 2:
                break
    return (title, lines[:most]) if len(lines) >= least else None


def detect(documents: DataFrame, key: str = "doc_id", text: str = "text", least: int = 3, most: int = 150) -> DataFrame:
    """doc_id, title, entries (with levels), entry_count, language for documents that have a table of contents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, *f) for k, t in zip(batch["doc_id"], batch["text"], strict=True) if (f := find_toc(t, least, most))]
            yield pd.DataFrame({"doc_id": [k for k, _, _ in found], "title": pd.Series([t for _, t, _ in found], dtype=object), "lines": pd.Series([x for _, _, x in found], dtype=object)})

    lines = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, title string, lines array<string>")
    entry = lambda x: let(entry_parts(x), lambda p: F.struct(
        p["title"].alias("title"), p["page"].alias("page"),
        F.least(F.floor((F.char_length(x) - F.char_length(F.ltrim(x))) / 2), F.lit(3)).cast("int").alias("level"), F.trim(x).alias("text"),
        p["section"].alias("section"),
    ))
    entries = entry_levels(F.transform("lines", entry))
    return lines.select("doc_id", "title", entries.alias("entries")).select(
        "*", F.size("entries").alias("entry_count"), toc_language(F.col("title"), F.col("entries")).alias("language")
    )
