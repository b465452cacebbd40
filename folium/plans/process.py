"""Files or tables of text to exported documents: extract, clean, correct, classify, segment, chunk, describe."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from folium.functions import classify, metadata, segments, text as T, toc
from folium.operators import chunking, spelling
from folium.sources import files as sources


@dataclass(frozen=True)
class Options:
    min_line: int = 3
    collapse_newlines: bool = False
    longest: int = 1000
    overlap: int = 200
    include_sections: bool = False
    strategy: str = "size"  # size, semantic or hybrid
    threshold: float = 0.65
    summary_longest: int = 150
    class_threshold: float = 0.6
    as_of: str = "2100-01-01"
    header_patterns: tuple[str, ...] | None = None
    vocabulary: dict = field(default_factory=dict)
    route: bool = True  # documents of a category with a pipeline of its own are chunked by its settings


TECHNICAL = Options(longest=2000)
#: Specialised settings by category; others run with the general ones.
PIPELINES: dict[str, Options] = {"technical": TECHNICAL}


def options_for(category: str | None, general: Options = Options()) -> Options:
    """The settings of a category's pipeline, or the general ones."""
    special = PIPELINES.get(category or "")
    return replace(special, as_of=general.as_of) if special else general


def clean_documents(documents: DataFrame, o: Options = Options(), text: str = "text") -> DataFrame:
    """Cleaned ``text`` (and pages, if there are any); the raw text stays as original_text."""
    out = documents.withColumn("original_text", F.col(text)).withColumn(text, T.clean(text, o.min_line, collapse_newlines=o.collapse_newlines))
    if "pages" in documents.columns:
        out = out.withColumn("pages", F.transform("pages", lambda p: p.withField("text", T.clean(p["text"], o.min_line, collapse_newlines=o.collapse_newlines))))
    return out


def classify_documents(documents: DataFrame, o: Options = Options(), text: str = "text", filename: str | None = None) -> DataFrame:
    """classification (metadata and content combined) and both of its parts."""
    content = classify.classify_content(text, o.vocabulary or None, o.class_threshold)
    out = documents.withColumn("content_class", content)
    name = F.col(filename) if filename else F.lit("")
    out = out.withColumn("metadata_class", classify.classify_metadata(name, F.lit(""), o.vocabulary or None, o.class_threshold))
    return out.withColumn("classification", classify.combine(
        F.col("metadata_class.category"), F.col("metadata_class.confidence"), F.col("content_class.category"), F.col("content_class.confidence")))


def segment_documents(documents: DataFrame, o: Options = Options(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its segments in order; entries of a table of contents are marked."""
    rows = segments.segment_rows(documents, key, text, list(o.header_patterns) if o.header_patterns else None, o.include_sections)
    marked = rows.withColumn("is_toc", (F.col("type") != "section") & (toc.is_toc_title(F.col("text")) | (F.regexp_like("text", F.lit(r"\.{3,}\s*\d+\s*$")))))
    return segments.segments_array(marked)


def chunk_documents(segmented: DataFrame, o: Options = Options()) -> DataFrame:
    """Chunks with summaries by the chosen strategy."""
    if o.strategy == "semantic":
        chunks = chunking.semantic_chunks(segmented, threshold=o.threshold, longest=o.longest)
    else:
        chunks = segments.rebalance(segments.size_chunks(segmented, o.longest, o.overlap))
        if o.strategy == "hybrid":
            chunks = chunking.hybrid_chunks(chunks, threshold=o.threshold, longest=o.longest)
    return chunks.withColumn("summary", segments.summary("text", o.summary_longest))


def chunk_routed(segmented: DataFrame, classes: DataFrame, o: Options = Options()) -> DataFrame:
    """Chunks of all documents, each by the settings of its category's pipeline.

    ``classes``: doc_id, category.  There is one pass for each pipeline and one for all that have none.
    """
    if not o.route or o.strategy != Options().strategy:
        return chunk_documents(segmented, o)
    special = classes.where(F.col("category").isin(*PIPELINES))
    out = chunk_documents(segmented.join(special, "doc_id", "left_anti"), o)
    for category in PIPELINES:
        own = segmented.join(special.where(F.col("category") == category), "doc_id", "left_semi")
        out = out.unionByName(chunk_documents(own, options_for(category, o)))
    return out


def process(documents: DataFrame, o: Options = Options(), key: str = "doc_id", text: str = "text", dictionary: DataFrame | None = None,
            filename: str | None = None) -> dict[str, DataFrame]:
    """Documents with metadata and classes, their segments, and their chunks.

    With a dictionary the text is spell-corrected after cleaning.
    """
    cleaned = clean_documents(documents, o, text)
    if dictionary is not None:
        fixed = spelling.correct_documents(cleaned.drop("original_text"), dictionary, key, text).drop("original_text")
        cleaned = cleaned.drop(text).join(fixed, key)
    described = classify_documents(cleaned, o, text, filename).withColumn(
        "metadata", metadata.extract_metadata(text, F.lit(o.as_of).cast("date"), path=F.col(filename) if filename else None)
    )
    segmented = segment_documents(cleaned, o, key, text)
    classes = described.select(F.col(key).alias("doc_id"), F.col("classification.category").alias("category"))
    return {"documents": described, "segments": segmented, "chunks": chunk_routed(segmented, classes, o)}


def process_directory(spark: SparkSession, path: str, o: Options = Options(), pdf: Callable | None = None, ocr: Callable | None = None,
                      recursive: bool = True) -> dict[str, DataFrame]:
    """Supported files below a path, processed; files that fail are rows with their error."""
    extracted = sources.extract(sources.list_files(spark, path, recursive), pdf, ocr).withColumn("doc_id", F.xxhash64("path"))
    out = process(extracted.where("success"), o, filename="filename")
    return out | {"files": extracted}
