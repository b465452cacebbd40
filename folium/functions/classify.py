"""Rule classification, technical features and the combination of classes, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from folium.functions import fixed
from folium.functions.text import best_of, col, count_of, let, word_count


def support(extension: Column) -> Column:
    return F.lower(extension).isin(*fixed.EXTENSIONS)


def format_hints(filename: Column | str, vocabulary: dict[str, list[str]] | None = None) -> Column:
    """Kinds whose words occur in a file name, in declared order."""
    name = F.lower(col(filename))
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(w) for w in ws]).alias("ws")) for k, ws in (vocabulary or fixed.FORMAT_HINTS).items()])
    return F.transform(F.filter(table, lambda t: F.exists(t["ws"], lambda w: F.contains(name, w))), lambda t: t["k"])


def _result(value: Column, scores: Callable[[Column], list[tuple[str, Column]]], threshold: float, method: str) -> Column:
    """Category (unknown under the threshold), confidence, method and all scores of a value that is computed once."""
    table = let(value, lambda v: F.array(*[F.struct(s.cast("double").alias("score"), F.lit(-i).alias("at"), F.lit(n).alias("name")) for i, (n, s) in enumerate(scores(v))]))
    return let(table, lambda t: let(F.array_max(t), lambda b: F.struct(
        F.when(b["score"] >= threshold, b["name"]).otherwise("unknown").alias("category"), b["score"].alias("confidence"), F.lit(method).alias("method"),
        F.map_from_entries(F.transform(t, lambda x: F.struct(x["name"], x["score"]))).alias("scores"),
    )))


def classify_metadata(filename: Column | str, description: Column | str, vocabulary: dict[str, list[str]] | None = None, threshold: float = 0.6) -> Column:
    """Two points per keyword in the file name, one in the media type's description; five points are full."""
    both = F.struct(F.lower(col(filename)).alias("name"), F.lower(F.coalesce(col(description), F.lit(""))).alias("text"))
    points = lambda z, w: F.contains(z["name"], F.lit(w)).cast("int") * 2 + F.contains(z["text"], F.lit(w)).cast("int")
    full = lambda z, ws: F.least(sum((points(z, w) for w in ws[1:]), points(z, ws[0])) / F.lit(5.0), F.lit(1.0))
    return _result(both, lambda z: [(c, full(z, ws)) for c, ws in (vocabulary or fixed.CATEGORIES).items()], threshold, "metadata")


def content_samples(text: Column) -> Column:
    """Beginning, middle and end of a lowered text, each of at most a third or 5000 characters."""
    low = F.lower(text)
    size = F.char_length(low)
    n = F.least(F.lit(5000), F.floor(size / 3)).cast("int")
    middle = (F.floor(size / 2) - F.floor(n / 2)).cast("int")
    return F.concat_ws(" ", F.substring(low, F.lit(1), n), F.substring(low, middle + 1, n), F.substring(low, size - n + 1, n))


def classify_content(text: Column | str, vocabulary: dict[str, list[str]] | None = None, threshold: float = 0.6) -> Column:
    """Whole-word sightings of keywords in three samples; twenty are full."""
    share = lambda z, ws: F.least(F.regexp_count(z, F.lit(r"\b(?:" + "|".join(ws) + r")\b")) / F.lit(20.0), F.lit(1.0))
    return _result(content_samples(col(text)), lambda z: [(c, share(z, ws)) for c, ws in (vocabulary or fixed.CATEGORIES).items()], threshold, "rules")


def combine(metadata_category: Column, metadata_confidence: Column, content_category: Column, content_confidence: Column) -> Column:
    """The same class has the mean confidence; else the surer one, metadata on a tie."""
    same = metadata_category == content_category
    surer = content_confidence > metadata_confidence
    return F.struct(
        F.when(same, metadata_category).when(surer, content_category).otherwise(metadata_category).alias("category"),
        F.when(same, (metadata_confidence + content_confidence) / 2).when(surer, content_confidence).otherwise(metadata_confidence).alias("confidence"),
        F.when(same, "combined").when(surer, "content").otherwise("metadata").alias("method"),
    )


def size_class(size_bytes: Column) -> Column:
    mb = size_bytes / F.lit(1024.0 * 1024.0)
    return F.when(mb < 0.1, "very_small").when(mb < 1, "small").when(mb < 10, "medium").when(mb < 50, "large").otherwise("very_large")


def technical_features(text: Column | str, segments: Column | None = None, terms: list[str] | None = None) -> Column:
    """Sightings of technical terms per word, their level, and which kinds of segment occur."""
    words = terms or fixed.TECHNICAL_DENSITY
    hits = lambda low: sum((count_of(low, t) for t in words[1:]), count_of(low, words[0]))
    level = lambda d: F.when(d > 0.05, "high").when(d > 0.02, "medium").when(d > 0, "low").otherwise("unknown")
    has = lambda kind: F.exists(segments, lambda s: s["type"] == kind) if segments is not None else F.lit(False)
    counted = let(F.lower(col(text)), lambda low: F.struct(hits(low).alias("n"), word_count(low).alias("words")))
    dense = let(counted, lambda c: F.struct(c["n"].alias("n"), F.when(c["words"] > 0, c["n"] / c["words"]).otherwise(F.lit(0.0)).alias("d")))
    return let(dense, lambda x: F.struct(
        x["n"].alias("term_count"), x["d"].alias("density"), level(x["d"]).alias("complexity"), has("table").alias("has_tables"),
        has("code").alias("has_code"), has("equation").alias("has_equations"),
    ))


def accept_rewrite(query: Column, rewritten: Column) -> Column:
    """A rewrite must differ, keep 80 % of the length, and have three words."""
    norm = lambda c: F.lower(F.trim(c))
    words = F.size(F.filter(F.split(F.trim(rewritten), r"\s+"), lambda w: w != ""))
    return F.coalesce(
        (norm(query) != norm(rewritten)) & (F.char_length(rewritten) >= F.char_length(query) * 0.8) & (words >= 3), F.lit(False)
    )
