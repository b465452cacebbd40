"""Processed documents, dictionaries, prompt sets, catalogues and configuration."""

from __future__ import annotations

import json
import os
import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

DOCUMENT = (
    "text string, metadata struct<title:string,author:string,date:string,language:string,topics:array<string>,"
    "file:struct<path:string,hash:string,name:string>>, chunks array<struct<id:string,text:string,summary:string,"
    "segments:array<struct<type:string,text:string,level:int,section:string>>>>, segments array<struct<type:string,text:string,level:int,section:string,title:string>>"
)
DEFAULTS = {
    "cleaning": {"min_line_length": 3, "collapse_newlines": False},
    "segmentation": {"max_chunk_size": 1000, "overlap": 200, "semantic_chunking": False, "semantic_similarity_threshold": 0.65, "toc_min_entries": 3, "toc_max_entries": 150},
    "classification": {"threshold": 0.6},
    "spelling": {"enabled": False, "max_edit_distance": 2},
    "rag": {"top_k": 5, "summary_weight": 0.3, "summary_threshold": 0.4, "summary_boost": 0.2, "min_score": None},
    "export": {"formats": ["markdown", "json"]},
}


def merge(base: dict, over: dict) -> dict:
    """Nested dictionaries, the second over the first; neither is changed."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str | None = None, defaults: dict | None = None) -> dict:
    """TOML, JSON or YAML over the defaults; ``${section.key}`` and ``${ENV}`` are resolved."""
    base = defaults or DEFAULTS
    if path is None:
        return base
    raw = Path(path).read_text("utf-8")
    if path.endswith(".toml"):
        given = tomllib.loads(raw)
    elif path.endswith(".json"):
        given = json.loads(raw)
    else:
        import yaml

        given = yaml.safe_load(raw) or {}
    whole = merge(base, given)

    def value(name: str):
        at = whole
        for part in name.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        return os.environ.get(name, "") if at is None else at

    def resolve(x):
        if isinstance(x, dict):
            return {k: resolve(v) for k, v in x.items()}
        if isinstance(x, list):
            return [resolve(v) for v in x]
        if isinstance(x, str):
            alone = re.fullmatch(r"\$\{([^}]+)\}", x)
            return value(alone[1]) if alone else re.sub(r"\$\{([^}]+)\}", lambda m: str(value(m[1])), x)
        return x

    return resolve(whole)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Exported JSON documents below a path, with the file each came from."""
    reader = spark.read.schema(DOCUMENT).option("multiLine", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    return reader.json(path).withColumn("source_path", F.input_file_name())


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """Markdown files, each one chunk."""
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path)
    return whole.select(F.sha2("value", 256).alias("document_id"), F.lit("chunk_1").alias("chunk_id"), F.col("value").alias("text"),
                        F.regexp_extract("value", r"(?m)^#\s+(.+)$", 1).alias("title"), F.input_file_name().alias("source_path"))


def read_processed_dir(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of exported documents; where there are none, of Markdown files."""
    chunks = chunk_rows(read_processed(spark, path))
    if not chunks.isEmpty():
        return chunks
    return read_markdown(spark, path).select("document_id", "chunk_id", "text", F.lit(None).cast("string").alias("summary"), "title", F.array().cast("array<string>").alias("sections"))


def chunk_rows(documents: DataFrame, level: str = "chunks") -> DataFrame:
    """document_id, chunk_id, text, summary, title, sections: by chunk, paragraph, section, or the whole text."""
    id_ = F.coalesce("metadata.file.hash", F.sha2(F.coalesce("text", F.to_json("chunks"), F.lit("")), 256)).alias("document_id")
    title = F.col("metadata.title").alias("title")
    if level == "chunks":
        return documents.select(id_, title, F.explode("chunks").alias("c")).select(
            "document_id", F.col("c.id").alias("chunk_id"), F.col("c.text").alias("text"), F.col("c.summary").alias("summary"), "title",
            F.transform(F.filter(F.coalesce("c.segments", F.array().cast("array<struct<type:string,text:string,level:int,section:string>>")), lambda s: s["type"] == "header"), lambda s: s["text"]).alias("sections"),
        )
    if level in ("paragraphs", "sections"):
        rows = documents.select(id_, title, F.posexplode("segments").alias("at", "s")).where(F.col("s.type") == level[:-1])
        return rows.select(
            "document_id", F.concat(F.lit(f"{level[:-1]}_"), (F.col("at") + 1).cast("string")).alias("chunk_id"), F.col("s.text").alias("text"),
            F.lit(None).cast("string").alias("summary"), "title", F.filter(F.array(F.coalesce("s.section", "s.title")), lambda x: x.isNotNull()).alias("sections"),
        )
    return documents.select(id_, F.lit("full_text").alias("chunk_id"), "text", F.lit(None).cast("string").alias("summary"), title, F.array().cast("array<string>").alias("sections"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``word<TAB>frequency`` lines; a number sign begins a comment."""
    return spark.read.csv(path, sep="\t", comment="#", schema="term string, frequency long").where("term IS NOT NULL AND frequency IS NOT NULL")


def read_prompts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Prompts and assertions of a YAML or JSON prompt set."""
    raw = Path(path).read_text("utf-8")
    if path.endswith(".json"):
        data = json.loads(raw)
    else:
        import yaml

        data = yaml.safe_load(raw) or {}
    prompts = [(i, str(p)) for i, p in enumerate(data.get("prompts") or [])]
    rows = []
    for t, test in enumerate(data.get("tests") or []):
        for a in test.get("assert") or []:
            v = a.get("value")
            rows.append((t, test.get("description"), a.get("type"), [str(x) for x in v] if isinstance(v, list) else [json.dumps(v) if isinstance(v, dict) else str(v)]))
    return (spark.createDataFrame(prompts, "prompt_id int, prompt string"), spark.createDataFrame(rows, "test_id int, description string, type string, value array<string>"))


def check_prompt_set(data: dict) -> list[str]:
    """What is wrong with a prompt set: every variant needs a chunking strategy and no model settings."""
    wrong = []
    for i, v in enumerate(data.get("variants") or []):
        config = v.get("config") or {}
        name = v.get("name") or f"variant {i}"
        if "chunking_strategy" not in config:
            wrong.append(f"{name}: no chunking_strategy")
        wrong += [f"{name}: {k} is not a variant's setting" for k in ("model", "temperature", "endpoint") if k in config]
    return wrong


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Processed and source files below a path, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.select("path", "length", "modificationTime", ext.alias("extension")).where(ext.isin(".md", ".json", ".pdf", ".docx", ".txt"))
