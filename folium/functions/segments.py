"""Paragraphs, headers, sentences, segments and chunks as column expressions."""

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from folium.functions import fixed
from folium.functions.text import SPACE, any_of, col, display, let, strip

SEGMENT = "struct<pos:int,type:string,text:string,level:int,section:string,title:string,length:int,is_toc:boolean>"


def paragraphs(text: Column | str, scanned: Column | None = None) -> Column:
    """Blocks between blank lines, or finer where the text has hardly any (see the four steps).

    1. blank lines; 2. if fewer than ten blocks in more than 3000 characters, or the text looks
    scanned, line ends before an indent, a bullet or a number; 3. for scanned text also sentence ends
    before capitals, if that gives 1.2 times as many; 4. fewer than 15 blocks, one of them over 800
    characters: groups of four sentences.
    """
    body = col(text)
    blocks = F.split(body, r"\n\s*\n")
    lines, words = F.size(F.split(body, "\n")), F.size(F.split(strip(body), rf"(?U){SPACE}+"))
    looks = scanned if scanned is not None else (F.char_length(body) > 1000) & (words / lines > 20)
    finer = F.split(body, r"\n(?=\s{2,}|[•\-*]|\d+\.)")
    some = F.when(((F.size(blocks) < 10) & (F.char_length(body) > 3000)) | looks, finer).otherwise(blocks)
    capitals = F.split(body, r"(?<=[.!?])\s+(?=[A-Z]{2,})")
    some = let(some, lambda s: F.when(looks & (F.size(capitals) > F.size(s) * 1.2), capitals).otherwise(s))
    four = lambda s: F.flatten(F.transform(s, lambda p: F.when(F.char_length(p) > 800, in_fours(p)).otherwise(F.array(p))))
    long = lambda s: F.exists(s, lambda p: F.char_length(p) > 800)
    out = let(some, lambda s: F.when((F.size(s) < 15) & long(s), four(s)).otherwise(s))
    return F.filter(F.transform(out, strip), lambda p: p != "")


def in_fours(text: Column) -> Column:
    """Groups of four sentences."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    last = lambda s: F.greatest(F.ceil(F.size(s) / 4).cast("int") - 1, F.lit(0))
    return let(parts, lambda s: F.transform(F.sequence(F.lit(0), last(s)), lambda i: F.array_join(F.slice(s, i * 4 + 1, 4), " ")))


def is_header(text: Column | str, patterns: list[str] | None = None) -> Column:
    """Any of the header patterns from the start of the text on."""
    return F.regexp_like(col(text), F.lit(any_of(patterns or fixed.HEADERS)))


def header_level(text: Column | str) -> Column:
    """1 to 4 by numbering, by opening word, or by capitals."""
    t = col(text)
    opens = lambda words: F.regexp_like(t, F.lit("^(?:" + "|".join(words) + ")"))
    letters = F.regexp_like(t, F.lit(r"\p{L}"))
    title = letters & ~F.regexp_like(t, F.lit(r"\p{L}\p{Lu}|(?<!\p{L})\p{Ll}"))
    return (
        F.when(F.regexp_like(t, F.lit(r"^\d+\.\d+\.\d+\.\d+")), 4).when(F.regexp_like(t, F.lit(r"^\d+\.\d+\.\d+")), 3)
        .when(F.regexp_like(t, F.lit(r"^\d+\.\d+")), 2).when(F.regexp_like(t, F.lit(r"^\d+")), 1)
        .when(opens(fixed.LEVEL_1), 1).when(opens(fixed.LEVEL_2), 2).when(opens(fixed.LEVEL_1_OTHER), 1)
        .when(letters & (F.upper(t) == t), 1).when(title, 2).otherwise(3).cast("int")
    )


def sentences(text: Column | str) -> Column:
    """Split after an end mark before a capital; long ones also at line ends; a full stop is added where no mark ends one."""
    parts = F.split(col(text), r"(?<=[.!?])\s+(?=[A-Z])")
    fine = F.flatten(F.transform(parts, lambda s: F.when(F.char_length(s) > 200, F.split(s, r"\n(?=[A-Z]|\d+\.|[•\-*])")).otherwise(F.array(s))))
    kept = F.filter(F.transform(fine, strip), lambda s: s != "")
    return F.transform(kept, lambda s: F.when(F.regexp_like(s, F.lit(r"[.!?;:]$")), s).otherwise(F.concat(s, F.lit("."))))


def segment_rows(documents: DataFrame, key: str = "doc_id", text: str = "text", patterns: list[str] | None = None,
                 include_sections: bool = True, blocks: Column | None = None) -> DataFrame:
    """One row per segment: headers, paragraphs with the header they stand under, and sections.

    The section of a paragraph is the last header before it; a section's text is its paragraphs.
    A text without any header is one section of its own.
    """
    parts = documents.select(F.col(key).alias("doc_id"), F.posexplode(blocks if blocks is not None else paragraphs(text)).alias("pos", "text"))
    parts = parts.withColumn("header", is_header("text", patterns))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("section", F.last(F.when(F.col("header"), F.col("text")), ignorenulls=True).over(before)).withColumn(
        "group", F.sum(F.col("header").cast("int")).over(before)
    )
    base = placed.select(
        "doc_id", "pos", F.when(F.col("header"), "header").otherwise("paragraph").alias("type"), "text",
        F.when(F.col("header"), header_level("text")).alias("level"),
        F.when(~F.col("header"), F.col("section")).alias("section"), F.lit(None).cast("string").alias("title"), "group",
    )
    if include_sections:
        bodies = (
            placed.where(~F.col("header")).groupBy("doc_id", "group")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("p"), F.max("pos").alias("last"), F.first("section").alias("title"))
        )
        section = bodies.select(
            "doc_id", F.col("last").alias("pos"), F.lit("section").alias("type"), F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"),
            F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("section"), "title", "group",
        ).where("title IS NOT NULL OR group = 0")
        base = base.unionByName(section)
    order = Window.partitionBy("doc_id").orderBy("pos", F.when(F.col("type") == "section", 1).otherwise(0))
    return base.withColumn("pos", (F.row_number().over(order) - 1).cast("int")).select(
        "doc_id", "pos", "type", "text", "level", "section", "title", F.char_length("text").cast("int").alias("length"), F.lit(False).alias("is_toc")
    )


def segments_array(rows: DataFrame) -> DataFrame:
    """doc_id and its segments in order."""
    fields = ("pos", "type", "text", "level", "section", "title", "length", "is_toc")
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("segments"))


# --- chunks by size -----------------------------------------------------------------------------


def pack_positions(segments: Column, longest: int = 1000, overlap: int = 200, shortest: int = 5) -> Column:
    """Chunks as arrays of indices into ``segments`` (structs with type and length), by one fold.

    Headers join without a limit; a segment that would exceed ``longest`` opens a chunk that begins
    with the paragraphs that end the last one, until they reach ``overlap``.
    """
    segs = segments
    usable = F.filter(F.sequence(F.lit(0), F.size(segs) - 1), lambda i: (F.size(segs) > 0) & (F.get(segs, i)["length"] >= shortest))
    empty = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("size"), empty.alias("cur"), F.array().cast("array<array<int>>").alias("out"))
    length = lambda i: F.get(segs, i)["length"]
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, i: a + length(i) + 2)

    def tail(cur: Column) -> Column:
        texts = F.filter(cur, lambda i: F.get(segs, i)["type"] != "header")
        back = F.aggregate(
            F.reverse(texts), F.struct(F.lit(0).alias("n"), empty.alias("kept")),
            lambda a, i: F.when(
                a["n"] >= overlap, a
            ).otherwise(F.struct((a["n"] + length(i)).cast("int").alias("n"), F.concat(F.array(i), a["kept"]).alias("kept"))),
        )
        return back["kept"]

    def step(a: Column, i: Column) -> Column:
        join = F.struct((a["size"] + length(i) + 2).cast("int").alias("size"), F.concat(a["cur"], F.array(i)).alias("cur"), a["out"].alias("out"))
        fresh = F.concat(tail(a["cur"]), F.array(i))
        flush = F.struct(total(fresh).cast("int").alias("size"), fresh.alias("cur"), F.concat(a["out"], F.array(a["cur"])).alias("out"))
        full = (F.get(segs, i)["type"] != "header") & (a["size"] + length(i) > longest) & (F.size(a["cur"]) > 0)
        return F.when(full, flush).otherwise(join)

    return F.aggregate(usable, start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))


def pack_simple(parts: Column, longest: int = 500) -> Column:
    """Strings packed greedily into chunks of at most ``longest`` characters, joined by spaces."""
    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fits = (a["cur"] == "") | (F.char_length(a["cur"]) + 1 + F.char_length(s) <= longest)
        grown = F.when(a["cur"] == "", s).otherwise(F.concat(a["cur"], F.lit(" "), s))
        return F.struct(F.when(fits, grown).otherwise(s).alias("cur"), F.when(fits, a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))).alias("out"))

    return F.aggregate(parts, start, step, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(a["cur"]))).otherwise(a["out"]))


def size_chunks(segmented: DataFrame, longest: int = 1000, overlap: int = 200, scanned: Column | None = None) -> DataFrame:
    """``doc_id, segments`` -> one row per chunk, before rebalancing."""
    few = (scanned if scanned is not None else F.lit(False)) & (F.size("segments") < 5)
    packed = segmented.select("doc_id", "segments", F.when(few, pack_positions(F.col("segments"), min(longest, 800), overlap)).otherwise(pack_positions(F.col("segments"), longest, overlap)).alias("packs"))
    rows = packed.select("doc_id", "segments", F.posexplode("packs").alias("at", "positions"))
    text = strip(F.array_join(F.transform("positions", lambda i: F.get("segments", i)["text"]), "\n\n"))
    sections = F.array_distinct(F.filter(F.transform("positions", lambda i: F.get("segments", i)["section"]), lambda s: s.isNotNull()))
    return rows.select(
        "doc_id", (F.col("at") + 1).alias("chunk_no"), text.alias("text"), F.col("positions").alias("segment_pos"), sections.alias("sections")
    ).withColumn("length", F.char_length("text").cast("int"))


def rebalance(chunks: DataFrame, total: Column | None = None) -> DataFrame:
    """Few long chunks: the three longest of at least 800 characters and six sentences are halved.

    The halves go to the end; chunks are numbered anew.  Applies to documents of more than 2000
    characters with fewer than max(2, total div 1000) chunks.
    """
    w = Window.partitionBy("doc_id")
    measured = chunks.withColumn("total", F.sum("length").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    measured = measured.withColumn("few", (F.col("n") < F.greatest(F.lit(2), F.floor(F.col("total") / 1000))) & (F.col("total") > 2000))
    ranked = measured.withColumn("rank", F.row_number().over(w.orderBy(F.col("length").desc(), "chunk_no"))).withColumn("parts", sentences("text"))
    halved = F.col("few") & (F.col("rank") <= 3) & (F.col("length") >= 800) & (F.size("parts") >= 6)
    half = F.floor(F.size("parts") / 2).cast("int")
    first = F.array_join(F.slice("parts", 1, half), " ")
    second = F.array_join(F.slice("parts", half + 1, F.size("parts")), " ")
    texts = F.when(halved, F.array(first, second)).otherwise(F.array("text"))
    rows = ranked.select("doc_id", "chunk_no", "rank", halved.alias("late"), "segment_pos", "sections", F.posexplode(texts).alias("half", "text"))
    order = w.orderBy("late", F.when(F.col("late"), F.col("rank")).otherwise(F.col("chunk_no")), "half")
    return rows.select(
        "doc_id", F.row_number().over(order).alias("chunk_no"), "text", "segment_pos", "sections", F.char_length("text").cast("int").alias("length")
    ).withColumn("chunk_id", F.concat(F.lit("chunk_"), F.col("chunk_no").cast("string")))


# --- extractive summary -------------------------------------------------------------------------


def summarize(text: str | None, longest: int = 150, count: int = 2) -> str | None:
    """First sentence and the best of the others by mean frequency of their longer words.

    Texts under 100 characters are cut at ``longest``; one or two sentences are all taken; longer
    results are cut at the last space, with an ellipsis.
    """
    if text is None:
        return None
    if len(text) < 100:
        return text[:longest]
    parts = split_sentences(text)
    if len(parts) <= 2:
        return " ".join(parts)
    words = lambda t: [w for w in re.findall(r"\w+", t.lower()) if len(w) > 3]
    heard = Counter(words(text))
    value = lambda own: sum(heard[w] for w in own) / len(own) if own else 0.0
    best = sorted(range(1, len(parts)), key=lambda i: (-value(words(parts[i])), i))[: count - 1]
    out = " ".join([parts[0], *(parts[i] for i in sorted(best))])
    return out if len(out) <= longest else re.sub(r"\s+\S*$", "", out[:longest]) + "..."


def split_sentences(text: str) -> list[str]:
    """``sentences`` for one string."""
    out = []
    for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text):
        out += re.split(r"\n(?=[A-Z]|\d+\.|[•\-*])", s) if len(s) > 200 else [s]
    return [s if s[-1] in ".!?;:" else s + "." for s in map(str.strip, out) if s]


def summary(text: Column | str, longest: int = 150, count: int = 2, compose: bool = False) -> Column:
    """``summarize`` as a column, in display form.

    Word frequencies of one text are a dictionary's work: as higher-order functions this is quadratic
    in the text, so it is an Arrow batch function.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([summarize(t, longest, count) for t in texts], index=texts.index, dtype=object)

    return display(run(col(text)), compose)
