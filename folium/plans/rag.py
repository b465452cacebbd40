"""Index and question answering: embed chunks, retrieve, rerank, assemble, answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from folium.functions import vectors as V
from folium.functions.classify import accept_rewrite
from folium.functions.metadata import language
from folium.operators import retrieval as R


@dataclass(frozen=True)
class RagOptions:
    top_k: int = 5
    summary_weight: float = 0.3
    summary_threshold: float = 0.4
    summary_boost: float = 0.2
    min_score: float | None = None
    embedder_id: str = "hashing-384"
    prompt: str = "Answer in {language} from these passages.\n\n{context}\n\nQuestion: {query}\nAnswer:"
    rewrite_prompt: str = "Rewrite this question for retrieval, in {language}:\n{query}"


def build_index(chunks: DataFrame, o: RagOptions = RagOptions(), embedder: V.Embedder | None = None) -> DataFrame:
    """vec_id, document_id, chunk_id, text, summary, title, sections, embedding, embedder_id.

    An embedding blends text and summary (the first 200 characters where there is none).
    """
    brief = F.coalesce(F.nullif("summary", F.lit("")), F.substring("text", 1, 200))
    embedded = chunks.withColumn("_t", V.embed("text", embedder)).withColumn("_s", V.embed(brief, embedder))
    whole = embedded.withColumn("embedding", V.blend("_t", "_s", o.summary_weight)).drop("_t", "_s")
    keyed = whole.withColumn("vec_id", F.xxhash64("document_id", "chunk_id"))
    return keyed.withColumn("embedder_id", F.lit(o.embedder_id))


def rewrite(queries: DataFrame, provider: R.Provider | None = None, o: RagOptions = RagOptions()) -> DataFrame:
    """query_id, query -> also search_query: the rewrite if a provider gives one worth taking, else the query."""
    if provider is None:
        return queries.withColumn("search_query", F.col("query"))
    name = R.language_name(F.coalesce(language("query", shortest=0), F.lit("en")))
    prompt = F.replace(F.replace(F.lit(o.rewrite_prompt), F.lit("{language}"), name), F.lit("{query}"), F.col("query"))
    asked = queries.withColumn("_r", R.provider_column(prompt, provider))
    return asked.withColumn("search_query", F.when(accept_rewrite(F.col("query"), F.col("_r")), F.col("_r")).otherwise(F.col("query"))).drop("_r")


def retrieve(index: DataFrame, queries: DataFrame, o: RagOptions = RagOptions(), embedder: V.Embedder | None = None) -> DataFrame:
    """Hits with payload, reranked by how like the query their summaries are; queries that are blank have none."""
    asked = queries.where(F.trim("search_query") != "").withColumn("embedding", V.embed("search_query", embedder))
    hits = R.with_payload(R.knn(index, asked, o.top_k), index)
    if o.min_score is not None:
        hits = hits.where(F.col("score") >= o.min_score)
    with_query = hits.join(asked.select("query_id", F.col("embedding").alias("_q")), "query_id").withColumn("_s", V.embed("summary", embedder))
    like = with_query.withColumn("similarity", F.when(F.coalesce("summary", F.lit("")) != "", V.cosine("_s", "_q"))).drop("_s", "_q")
    return R.rerank(like, threshold=o.summary_threshold, boost=o.summary_boost, partition=["query_id"])


def answer(index: DataFrame, queries: DataFrame, o: RagOptions = RagOptions(), embedder: V.Embedder | None = None,
           rewriter: R.Provider | None = None, generator: R.Provider | None = None) -> DataFrame:
    """query_id, query, search_query, context, chunks_used, response, success, summaries.

    Without a generator the response is extractive; without hits it is a refusal.
    """
    asked = rewrite(queries, rewriter, o)
    hits = retrieve(index, asked, o, embedder)
    section = F.get("sections", F.lit(0)) if "sections" in index.columns else F.lit(None).cast("string")
    listed = hits.select("query_id", F.col("new_rank").alias("rank"), "title", section.alias("section"), "summary", "text")
    contexts = R.context(listed)
    passages = listed.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text", "summary"))), lambda x: x).alias("_p"))
    whole = asked.join(contexts, "query_id", "left").join(passages, "query_id", "left")
    name = R.language_name(F.coalesce(language("context", shortest=0), F.lit("en")))
    prompt = F.lit(o.prompt)
    for field, value in (("language", name), ("context", F.col("context")), ("query", F.col("query"))):
        prompt = F.replace(prompt, F.lit("{" + field + "}"), value)
    own = R.extractive_answer(F.col("query"), F.transform("_p", lambda x: x["text"]))
    response = F.coalesce(R.provider_column(F.when(F.col("_p").isNotNull(), prompt), generator), own) if generator else own
    return whole.select(
        "query_id", "query", "search_query", "context", F.coalesce("chunks_used", F.lit(0)).alias("chunks_used"),
        F.when(F.col("_p").isNull(), R.REFUSAL).otherwise(response).alias("response"), (F.trim("query") != "").alias("success"),
        F.filter(F.transform("_p", lambda x: x["summary"]), lambda s: s.isNotNull()).alias("summaries"),
    )


def evaluate(answers: DataFrame, assertions: DataFrame) -> DataFrame:
    """Every answer against every assertion (a prompt file's rows): broadcast if they are few, else block by block."""
    from folium.plans.summary import check_assertion

    tests = F.broadcast(assertions) if assertions.count() <= 10_000 else assertions
    checked = answers.select("query_id", "response").join(tests, how="cross")
    return checked.withColumn("passed", check_assertion(F.col("response"), F.col("type"), F.col("value")))


def label_agreement(hits: DataFrame, labels: DataFrame, key: str = "vec_id") -> DataFrame:
    """Share of hits that carry their query's label."""
    a, b = labels.select(F.col(key).alias("query_id"), F.col("label").alias("query_label")), labels.select(key, "label")
    return hits.join(a, "query_id").join(b, key).agg(F.round(F.avg((F.col("label") == F.col("query_label")).cast("int")), 6).alias("agreement"))


