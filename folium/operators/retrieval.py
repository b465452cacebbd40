"""Exact nearest neighbours, summary-aware reranking, context assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from folium.functions import fixed
from folium.functions.text import let
from folium.functions.vectors import cosine, l2_score, squared_l2

#: Queries whose vectors are sent to every task; more are answered in rounds of so many.
QUERIES_AT_ONCE = 4096
REFUSAL = "I don't have enough information to answer this question."


def top_k(index: DataFrame, query: Column, k: int = 5, metric: str = "l2", vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k nearest rows to one vector (a foldable column), with rank and score: a sort with a limit, no shuffle of the index."""
    if metric == "l2":
        scored = index.withColumn("_d", squared_l2(vector, query)).withColumn("score", l2_score(F.col("_d")))
        order = [F.col("_d"), F.col(key)]
    else:
        scored = index.withColumn("score", cosine(vector, query)).withColumn("_d", -F.col("score"))
        order = [F.col("_d"), F.col(key)]
    best = scored.where("_d IS NOT NULL").orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("_d")


def knn(index: DataFrame, queries: DataFrame, k: int = 5, metric: str = "l2", vector: str = "embedding", key: str = "vec_id",
        query_key: str = "query_id") -> DataFrame:
    """k nearest rows of ``index`` for every query: query_key, key, score, rank.

    Queries are collected in blocks of bounded size; each task multiplies its share of the index with
    a block and keeps k rows per query, so what is shuffled is k rows per task and query.
    """
    spark = index.sparkSession
    blocks = []
    ids, vectors = [], []
    for row in queries.select(query_key, vector).toLocalIterator():
        ids.append(row[0])
        vectors.append(row[1])
        if len(ids) == QUERIES_AT_ONCE:
            blocks.append((ids, np.array(vectors, np.float32)))
            ids, vectors = [], []
    if ids:
        blocks.append((ids, np.array(vectors, np.float32)))
    kinds = dict(index.dtypes)[key], dict(queries.dtypes)[query_key]
    schema = f"{query_key} {kinds[1]}, {key} {kinds[0]}, _d double"
    parts = [_block_knn(index.select(key, vector), block, k, metric, key, vector, query_key, schema, spark) for block in blocks]
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy(query_key).orderBy("_d", key)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    score = l2_score(F.col("_d")) if metric == "l2" else -F.col("_d")
    return ranked.select(query_key, key, score.alias("score"), "rank")


def _block_knn(index: DataFrame, block, k: int, metric: str, key: str, vector: str, query_key: str, schema: str, spark) -> DataFrame:
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = sent.value
        q = q.astype(np.float64)
        lengths = np.linalg.norm(q, axis=1)
        held_q, held_d, held_k = np.empty(0, np.int64), np.empty(0), None
        worst = np.full(len(ids), np.inf)  # of the k held for a query
        for batch in batches:
            if not len(batch):
                continue
            m = np.stack(batch[vector].to_numpy()).astype(np.float64)
            products = q @ m.T
            size = np.linalg.norm(m, axis=1)
            if metric == "l2":
                d = np.maximum(lengths[:, None] ** 2 + size[None, :] ** 2 - 2 * products, 0.0)
            else:
                with np.errstate(divide="ignore", invalid="ignore"):
                    d = -products / (lengths[:, None] * size[None, :])
            d = np.round(d, 9)
            d[~np.isfinite(d)] = np.inf
            # Only what is no farther than the k-th of the batch and of what is held is sorted.
            bound = np.minimum(worst, np.partition(d, k - 1, axis=1)[:, k - 1]) if d.shape[1] > k else worst
            at_q, at_row = np.nonzero((d <= bound[:, None]) & np.isfinite(d))
            names = batch[key].to_numpy()[at_row]
            every_q, every_d = np.concatenate([held_q, at_q]), np.concatenate([held_d, d[at_q, at_row]])
            every_k = names if held_k is None else np.concatenate([held_k, names])
            order = np.argsort(every_k, kind="stable")
            order = order[np.lexsort((every_d[order], every_q[order]))]
            every_q = every_q[order]
            place = np.arange(len(order)) - np.searchsorted(every_q, every_q)
            order = order[place < k]
            held_q, held_d, held_k = every_q[place < k], every_d[order], every_k[order]
            last = place[place < k] == k - 1
            worst[held_q[last]] = held_d[last]
        if len(held_q):
            yield pd.DataFrame({query_key: [ids[i] for i in held_q], key: held_k, "_d": held_d})

    return index.mapInPandas(run, schema)


def with_payload(hits: DataFrame, index: DataFrame, key: str = "vec_id") -> DataFrame:
    """Hits with the rows they name; names that are not in the index are dropped."""
    return hits.join(index.drop("embedding"), key)


def rerank(hits: DataFrame, similarity: str = "similarity", threshold: float = 0.4, boost: float = 0.2, partition: list[str] | None = None) -> DataFrame:
    """Summaries that are not like the query drop their hit, others raise its score; ranks are made anew.

    A hit without a summary (null similarity) stays as it is.
    """
    sim = F.col(similarity)
    kept = hits.where(sim.isNull() | (sim >= threshold))
    raised = kept.withColumn("original_score", F.col("score")).withColumn("score_boost", F.coalesce(sim * boost, F.lit(0.0))).withColumn(
        "score", F.when(sim.isNull(), F.col("score")).otherwise(F.least(F.lit(1.0), F.col("score") + sim * boost))
    )
    window = Window.partitionBy(*(partition or [F.lit(1)])).orderBy(F.col("score").desc(), "rank")
    return raised.withColumn("new_rank", F.row_number().over(window))


def context(hits: DataFrame, query_key: str = "query_id") -> DataFrame:
    """The retrieved passages of a query as one text, in order of rank."""
    part = lambda p: F.concat(
        F.lit("--- Document "), p["rank"].cast("string"), F.lit(": "), F.coalesce(p["title"], F.lit("Unknown")),
        F.coalesce(F.concat(F.lit(" - Section: "), p["section"]), F.lit("")), F.lit(" ---\n"),
        F.coalesce(F.concat(F.lit("Summary: "), p["summary"], F.lit("\n")), F.lit("")), F.lit("Content: "), p["text"],
    )
    listed = F.array_sort(F.collect_list(F.struct("rank", "title", "section", "summary", "text")))
    return hits.groupBy(query_key).agg(listed.alias("p")).select(query_key, F.array_join(F.transform("p", part), "\n\n").alias("context"), F.size("p").alias("chunks_used"))


def language_name(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fixed.LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


Provider = Callable[[str], str]


def provider_column(prompt: Column, provider: Provider) -> Column:
    """Answers of an injected text model, a batch at a time; a failing call gives null and its row goes on."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(p):
            try:
                return provider(p) if p is not None else None
            except Exception:
                return None

        for prompts in batches:
            yield pd.Series([one(p) for p in prompts], index=prompts.index, dtype=object)

    return run(prompt)


def extractive_answer(query: Column, passages: Column, count: int = 2) -> Column:
    """The sentences of the passages that share most words with the query, in order: an answer without a model."""
    from folium.functions.segments import sentences

    words = lambda t: F.array_distinct(F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)(\w+)"), F.lit(1)), lambda w: F.char_length(w) > 3))
    score = lambda s, i, asked: F.struct((-F.size(F.array_intersect(words(s), asked))).alias("v"), i.alias("i"), s.alias("s"))
    given = F.struct(words(query).alias("asked"), F.flatten(F.transform(passages, sentences)).alias("every"))
    scored = let(given, lambda z: F.transform(z["every"], lambda s, i: score(s, i, z["asked"])))
    best = F.array_sort(F.transform(F.slice(F.array_sort(scored), 1, count), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    return F.coalesce(F.nullif(F.array_join(F.transform(best, lambda x: x["s"]), " "), F.lit("")), F.lit(REFUSAL))
