"""Documents as Markdown, JSON and plain text; indexes, logs, summaries, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from folium.functions.text import display, slices, to_ascii

LOG_COLUMNS = (
    "timestamp timestamp, filename string, path string, file_type string, size_bytes bigint, status string, component string, phase string, "
    "error string, extraction_method string, has_text_layer boolean, language string, title string, author string, date string, topics array<string>, "
    "word_count bigint, page_count int, chunk_count int, processing_time_ms bigint"
)


def file_name(title: Column, date: Column | None = None, longest: int = 100) -> Column:
    """A title as a file name: letters, digits, hyphen and underscore, with a date in front if there is one."""
    plain = F.substring(F.regexp_replace(F.coalesce(title, F.lit("document")), r"[^\p{L}\p{N} _\-]", "_"), 1, longest)
    joined = F.concat(F.coalesce(F.concat(F.date_format(date, "yyyyMMdd"), F.lit("_")), F.lit("")), plain) if date is not None else plain
    return F.regexp_replace(F.replace(joined, F.lit(" "), F.lit("_")), "_{2,}", "_")


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def markdown(title: Column, chunks: Column, author: Column | None = None, date: Column | None = None, language: Column | None = None, topics: Column | None = None) -> Column:
    """Front matter, title, a metadata block, then chunks (structs of text and segments) between rules."""
    fields = [("title", title), ("author", author), ("date", date), ("language", language), ("topics", F.array_join(topics, ", ") if topics is not None else None)]
    given = [(n, c) for n, c in fields if c is not None]
    front = F.concat_ws("\n", F.lit("---"), *[_field(n, c) for n, c in given], F.lit("---"))
    block = F.concat_ws("\n", F.lit("## Metadata"), *[F.concat(F.lit(f"- **{n.capitalize()}**: "), c.cast("string")) for n, c in given])
    body = F.array_join(F.transform(chunks, lambda c: display(c["text"], False)), "\n\n---\n\n")
    return F.concat_ws("\n\n", front, F.concat(F.lit("# "), title), block, body)


def heading(text: Column, level: Column) -> Column:
    """A Markdown heading one level below the document's title, at most six."""
    return F.concat(F.repeat(F.lit("#"), F.least(level + 1, F.lit(6)).cast("int")), F.lit(" "), text)


def plain(title: Column, body: Column, author: Column | None = None, date: Column | None = None) -> Column:
    """Title in capitals, ruled, metadata, a line, the text."""
    head = F.concat(F.upper(title), F.lit("\n"), F.repeat(F.lit("="), F.char_length(title)))
    fields = [_field(n, c) for n, c in (("Author", author), ("Date", date)) if c is not None]
    return F.concat_ws("\n\n", head, *( [F.concat_ws("\n", *fields)] if fields else []), F.repeat(F.lit("-"), F.lit(80)), body)


def json_document(row: Column) -> Column:
    return F.to_json(row)


def corrected_pages(pages: Column, page: int = 5_000) -> Column:
    """Texts of the pages of a corrected document, split to what fits a page; nothing is left out."""
    return F.flatten(F.transform(pages, lambda p: slices(F.coalesce(p["text"], F.lit("")), page)))


def comparison_pages(original: Column, corrected: Column) -> Column:
    """Page pairs (original, corrected) with their lengths; pairs that are both hardly anything are left out.

    The original is the first of original_text and text that is not blank.
    """
    source = lambda p: F.coalesce(F.nullif(F.trim(p["original_text"]), F.lit("")), F.trim(p["text"]), F.lit(""))
    pairs = F.zip_with(original, corrected, lambda a, b: F.struct(
        source(a).alias("original"), F.coalesce(b["text"], F.lit("")).alias("corrected"),
        F.char_length(source(a)).alias("original_chars"), F.char_length(F.coalesce(b["text"], F.lit(""))).alias("corrected_chars"),
        (F.char_length(F.coalesce(b["text"], F.lit(""))) - F.char_length(source(a))).alias("difference"),
    ))
    return F.filter(pairs, lambda p: (p["original_chars"] >= 3) | (p["corrected_chars"] >= 3))


def export(documents: DataFrame, folder: str, formats: list[str], name: str = "name", **columns: str) -> dict[str, str]:
    """One table per format (markdown, json, text), a row per document: document, value; returns their paths.

    ``columns`` names the columns that hold each format's text.  A file or folder per document would be as
    many as there are documents; ``one_document`` takes a single one out.
    """
    out = {}
    for f in formats:
        path = f"{folder.rstrip('/')}/{f}"
        documents.select(F.col(name).alias("document"), F.col(columns.get(f, f)).alias("value")).write.mode("overwrite").parquet(path)
        out[f] = path
    return out


def one_document(spark, path: str, document: str) -> str | None:
    """The text of one exported document (the first by value if several share its name)."""
    row = spark.read.parquet(path).where(F.col("document") == document).agg(F.min("value")).first()
    return row[0]


def document_texts(chunks: DataFrame, described: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of processed documents: name, markdown, json and text, ready for ``export``.

    ``described`` has a row per document with title and, if known, author, date, language, topics; its
    chunks (chunk_no, text) follow in order.  A document without chunks has an empty body.
    """
    has = lambda c: F.col(c) if c in described.columns else None
    parts = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))).alias("c")).select(
        key, F.transform("c", lambda x: F.struct(x["text"].alias("text"), F.array().cast("array<struct<type:string,text:string,level:int>>").alias("segments"))).alias("chunks_")
    )
    rows = described.join(parts, key, "left").withColumn("chunks_", F.coalesce("chunks_", F.array().cast("array<struct<text:string,segments:array<struct<type:string,text:string,level:int>>>>")))
    title = F.coalesce("title", F.lit("document"))
    body = F.array_join(F.transform("chunks_", lambda c: c["text"]), "\n\n")
    return rows.select(
        key, file_name(F.col("title"), has("date")).alias("name"),
        markdown(title, F.col("chunks_"), has("author"), has("date"), has("language"), has("topics")).alias("markdown"),
        json_document(F.struct(*described.columns, F.transform("chunks_", lambda c: c["text"]).alias("chunks"))).alias("json"),
        plain(title, body, has("author"), has("date")).alias("text"),
    )


def save_index(index: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vectors, texts, summaries and the embedder's name in one Parquet table."""
    index.write.mode(mode).parquet(path)


def load_index(spark, path: str, embedder_id: str | None = None) -> DataFrame:
    """A saved index; another embedder than its own is refused."""
    index = spark.read.parquet(path)
    if embedder_id is not None and "embedder_id" in index.columns:
        if not index.where(F.col("embedder_id") != embedder_id).isEmpty():
            raise ValueError("the index was made with another embedder")
    return index


def append_vectors(index: DataFrame, new: DataFrame) -> DataFrame:
    """New rows behind the old ones: ids go on where they end, by document, then by chunk.

    Documents are numbered by a range sort: rows are counted per partition of the sorted table, and only
    those counts are summed up in one place.
    """
    from pyspark.sql import Window

    from folium.session import materialize

    last = index.agg(F.coalesce(F.max("vec_id"), F.lit(-1)).alias("last"))
    placed = materialize(new.orderBy("document_id", "chunk_id").withColumn("part_", F.spark_partition_id()))
    sizes = placed.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"))
    before = sizes.select("part_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    inside = F.row_number().over(Window.partitionBy("part_").orderBy("document_id", "chunk_id"))
    numbered = placed.join(F.broadcast(before), "part_").withColumn("vec_id", (F.col("before_") + inside).cast("long")).drop("part_", "before_")
    shifted = numbered.join(F.broadcast(last)).withColumn("vec_id", F.col("vec_id") + F.col("last")).drop("last")
    return index.unionByName(shifted, allowMissingColumns=True)


def upsert_vectors(index: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of old ones with the same keys."""
    return index.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def write_log(events: DataFrame, path: str) -> None:
    """Event log as CSV with a header; topics joined by bars."""
    flat = events.withColumn("topics", F.array_join("topics", "|")) if "topics" in events.columns else events
    flat.write.mode("append").option("header", True).csv(path)


def save_evaluation(results: DataFrame, folder: str, by: list[str] | None = None) -> dict[str, str]:
    """Evaluated assertions and their summaries as JSON lines: ``results``, ``summary`` and, with ``by``, ``groups``."""
    from folium.plans.summary import evaluation_summary

    out = {n: f"{folder.rstrip('/')}/{n}" for n in ("results", "summary", *(("groups",) if by else ()))}
    results.write.mode("overwrite").json(out["results"])
    evaluation_summary(results).write.mode("overwrite").json(out["summary"])
    if by:
        evaluation_summary(results, by).write.mode("overwrite").json(out["groups"])
    return out


def safe_title(title: Column) -> Column:
    return to_ascii(title)
