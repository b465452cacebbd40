"""Processing statistics and evaluation as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from folium.functions.metadata import language

COMPLETENESS = ("title", "author", "date", "language", "topics")


def final_events(events: DataFrame) -> DataFrame:
    """The last event of every file (statuses of one time: failed over warning over success)."""
    rank = F.when(F.col("status") == "failed", 2).when(F.col("status") == "warning", 1).otherwise(0)
    w = Window.partitionBy("path").orderBy(F.col("timestamp").desc(), rank.desc())
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def directory_summary(results: DataFrame) -> DataFrame:
    """total, success, failed, success_rate in percent; zero for nothing."""
    ok = F.sum(F.col("success").cast("long"))
    return results.agg(F.count(F.lit(1)).alias("total"), F.coalesce(ok, F.lit(0)).alias("success")).select(
        "total", "success", (F.col("total") - F.col("success")).alias("failed"),
        F.when(F.col("total") > 0, F.round(F.col("success") * 100.0 / F.col("total"), 2)).otherwise(F.lit(0.0)).alias("success_rate"),
    )


def index_summary(results: DataFrame) -> DataFrame:
    """``directory_summary`` and the chunks indexed by successes."""
    chunks = results.agg(F.coalesce(F.sum(F.when(F.col("success"), F.col("chunks_indexed"))), F.lit(0)).alias("total_chunks_indexed"))
    return directory_summary(results).join(F.broadcast(chunks))


def processing_summary(events: DataFrame) -> DataFrame:
    """dimension, value, n: counts by status, file type, extraction method, error, language and topic, in one pass."""
    error = F.when(F.char_length("error") > 50, F.concat(F.substring("error", 1, 50), F.lit("..."))).otherwise(F.col("error"))
    method = F.when(F.col("status") == "success", F.col("extraction_method"))
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.array(c).alias("vs")) for d, c in (
            ("status", F.col("status")), ("file_type", F.col("file_type")), ("extraction_method", method), ("error", error), ("language", F.col("language")))],
        F.struct(F.lit("topic").alias("dimension"), F.coalesce("topics", F.array().cast("array<string>")).alias("vs")),
    )
    return (
        events.select(F.explode(pairs).alias("p")).select("p.dimension", F.explode("p.vs").alias("value")).where("value IS NOT NULL")
        .groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def completeness(events: DataFrame) -> DataFrame:
    """Percentage of rows with each metadata field."""
    present = {c: F.col(c).isNotNull() if c != "topics" else F.coalesce(F.size("topics"), F.lit(0)) > 0 for c in COMPLETENESS}
    return events.agg(*[F.round(F.avg(p.cast("int")) * 100, 2).alias(c) for c, p in present.items()])


def segment_histogram(segments: DataFrame) -> DataFrame:
    return segments.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))


def check_assertion(response, kind, values) :
    """Whether a response meets an assertion: contains-any, not-contains-any, contains-json (a least length), language-match."""
    some = F.exists(values, lambda v: F.contains(F.lower(response), F.lower(v)))
    least = F.try_element_at(values, F.lit(1))
    length = F.coalesce(F.get_json_object(least, "$.min_length").try_cast("int"), least.try_cast("int"), F.lit(0))
    return (
        F.when(kind == "contains-any", some).when(kind == "not-contains-any", ~some)
        .when(kind == "contains-json", F.char_length(response) >= length).when(kind == "language-match", language(response, shortest=0) == least)
    )


def strategy_comparison(chunks: DataFrame) -> DataFrame:
    """Per strategy: chunks, mean length, share that is semantic."""
    return chunks.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("chunks"), F.round(F.avg("length"), 3).alias("avg_length"), F.round(F.avg(F.col("semantic").cast("int")) * 100, 2).alias("semantic_percent")
    )


def toc_success(documents: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """total, detected, success_rate in percent: documents of which a table of contents was found."""
    marked = documents.select(key).join(found.select(key).distinct().withColumn("hit", F.lit(1)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("hit"), F.lit(0)).alias("detected")).select(
        "total", "detected", F.when(F.col("total") > 0, F.round(F.col("detected") * 100.0 / F.col("total"), 2)).otherwise(F.lit(0.0)).alias("success_rate")
    )


def page_averages(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """pages, total_chars, chars_per_page (one decimal) of each document read by page; pages without text count."""
    total = F.aggregate(F.col(pages), F.lit(0), lambda n, p: n + F.coalesce(F.char_length(p["text"]), F.lit(0)))
    count = F.size(pages)
    return documents.where(F.col(pages).isNotNull()).withColumns({
        "page_count": count, "total_chars": total, "chars_per_page": F.when(count > 0, F.round(total / count, 1)).otherwise(F.lit(0.0)),
    })


def evaluation_summary(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """total, passed, failed, pass_rate in percent of evaluated assertions (column ``passed``), in all or by columns."""
    counted = results.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(F.col("passed").cast("long")), F.lit(0)).alias("passed"))
    return counted.withColumns({
        "failed": F.col("total") - F.col("passed"),
        "pass_rate": F.when(F.col("total") > 0, F.round(F.col("passed") * 100.0 / F.col("total"), 2)).otherwise(F.lit(0.0)),
    })


def metadata_lines(described: DataFrame, histogram: DataFrame, key: str = "doc_id") -> DataFrame:
    """One line of log for each document: its metadata fields that are known, and its counts of segments by type."""
    m = F.col("metadata")
    fields = [F.concat(F.lit(f"{n}: "), F.array_join(m[n], ", ") if n == "topics" else m[n].cast("string")) for n in COMPLETENESS]
    counts = histogram.groupBy(key).agg(F.array_sort(F.collect_list(F.concat_ws(" ", "type", F.col("n").cast("string")))).alias("counts_"))
    return described.join(counts, key, "left").select(key, F.concat_ws("; ", *fields, F.array_join("counts_", ", ")).alias("line"))


def retrieval_quality(hits: DataFrame, mode: str = "mode") -> DataFrame:
    """Mean top-1 score of every mode."""
    return hits.where("rank = 1").groupBy(mode).agg(F.round(F.avg("score"), 6).alias("mean_top1"), F.count(F.lit(1)).alias("queries"))
