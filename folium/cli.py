"""Command line: process a folder, index its chunks, answer questions, test prompts."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from folium.plans import process as P, rag
from folium.plans.rag import RagOptions
from folium.sinks import export as sinks
from folium.sources import processed


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="folium", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("process", help="process files into documents and chunks")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("--config")
    p.add_argument("--strategy", choices=["size", "semantic", "hybrid"], default="size")
    p.add_argument("--longest", type=int)
    p.add_argument("--dry-run", action="store_true", help="plan only; write nothing")
    i = sub.add_parser("index", help="embed chunks into an index")
    i.add_argument("chunks")
    i.add_argument("index")
    q = sub.add_parser("query", help="answer a question from an index")
    q.add_argument("index")
    q.add_argument("question", nargs="+")
    q.add_argument("--top-k", type=int, default=5)
    t = sub.add_parser("test-rag", help="run a prompt set and its assertions")
    t.add_argument("prompts")
    t.add_argument("index")
    t.add_argument("--output")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("folium").getOrCreate()
    if a.command == "process":
        config = processed.load_config(a.config)["segmentation"]
        o = P.Options(strategy=a.strategy, longest=a.longest or config["max_chunk_size"], overlap=config["overlap"])
        out = P.process_directory(spark, a.input, o, recursive=not a.no_recursive)
        if a.dry_run:
            out["chunks"].explain()
            return 0
        out["documents"].drop("content").write.mode("overwrite").parquet(f"{a.output}/documents")
        out["chunks"].write.mode("overwrite").parquet(f"{a.output}/chunks")
        return 0
    if a.command == "index":
        chunks = spark.read.parquet(a.chunks).withColumn("document_id", F.col("doc_id").cast("string")).withColumn("title", F.lit(None).cast("string"))
        sinks.save_index(rag.build_index(chunks), a.index)
        return 0
    index = sinks.load_index(spark, a.index, RagOptions().embedder_id)
    if a.command == "query":
        asked = spark.createDataFrame([(0, " ".join(a.question))], "query_id long, query string")
        print(rag.answer(index, asked, RagOptions(top_k=a.top_k)).first()["response"])
        return 0
    prompts, assertions = processed.read_prompts(spark, a.prompts)
    answers = rag.answer(index, prompts.select(F.col("prompt_id").cast("long").alias("query_id"), F.col("prompt").alias("query")))
    results = rag.evaluate(answers, assertions)
    if a.output:
        results.write.mode("overwrite").json(a.output)
    results.show(truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
