"""A training-corpus pipeline: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folium.llm import exact_dedup, jaccard, mixing, packing, quality
from folium.llm.queries import tokenizer_path
from folium.session import materialize, shared_folder, table

#: Keys of rows that go (or copies of rows that stay): broadcast up to this many, 50 bytes each at most.
BROADCAST_ROWS = 1_000_000


def _side(small: DataFrame) -> DataFrame:
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _held(docs: DataFrame) -> DataFrame:
    """row (all columns as they are, so that no name can clash with a stage's own), doc_id, text, source."""
    return docs.select(F.struct("*").alias("row"), "doc_id", "text", "source")


def _one_of_each(rows: DataFrame, *by: str) -> DataFrame:
    """One row of each group: the last by its columns written as JSON, so that reruns agree."""
    return rows.groupBy(*by).agg(F.max_by("row", F.to_json("row")).alias("row")).select("row")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects (score below 0.3) go.

    Null and empty texts are scored as any other; rows of one key are scored each by its own text; a
    null key is scored and never learned from.  All columns stay as they came, whatever their names.
    """
    scored = quality.score(_held(docs), table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null texts count as empty, null is the least key.

    Rows go by doc_id and digest; of rows alike in both, the last by its other columns stays.
    """
    held = _held(docs)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    found = exact_dedup.dedup(held.withColumn("part", part), "part", 2)
    alike = found.groupBy("doc_id", "digest").agg(F.max(F.col("kept").cast("int")).alias("kept"), F.count(F.lit(1)).alias("n"))
    odd = _side(materialize(alike.where("kept = 0 OR n > 1").select(F.col("doc_id").alias("id"), "digest", "kept")))
    marked = held.withColumn("sha", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)))
    joined = marked.join(odd, marked["doc_id"].eqNullSafe(odd["id"]) & (marked["sha"] == odd["digest"]), "left")
    single = joined.where(F.col("digest").isNull()).select("row")
    return single.unionByName(_one_of_each(joined.where("kept = 1"), "id", "digest")).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join one row stays: of the smallest doc_id, then the least class.

    Rows go by doc_id and class, so that what shares a key (or has none) with a near copy stays; of rows
    alike in both, the last by its other columns stays.  Null is the largest key.  Texts without words
    (null, empty or blank) are no copies.  All columns stay as they came, whatever their names.
    """
    held = _held(docs)
    found = jaccard.rows_of_components(held).where("n_shingles > 0")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("class") == F.col("keeper"))
    alike = found.groupBy("doc_id", "class").agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n"), F.first("seed").alias("seed"))
    odd = materialize(alike.where("NOT stays OR n > 1").select(F.col("doc_id").alias("id"), F.col("class").alias("odd"), "stays", "seed"))
    seed = odd.select("seed").first()
    if seed is None:
        return docs
    ids = _side(materialize(odd.select("id").distinct()))
    has_odd = held["doc_id"].eqNullSafe(ids["id"])
    clean = held.join(ids, has_odd, "left_anti").select("row")
    # Only rows of a key that some row goes by are shingled again.
    marked = jaccard.with_class(held.join(ids, has_odd, "left_semi"), "class", seed=seed["seed"])
    side = _side(odd)
    joined = marked.join(side, marked["doc_id"].eqNullSafe(side["id"]) & (marked["class"] == side["odd"]), "left")
    single = joined.where(F.col("odd").isNull()).select("row")
    return clean.unionByName(single).unionByName(_one_of_each(joined.where("stays"), "id", "odd")).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mixture takes them, each by its own number of copies.

    Null texts have size 0 and are not taken; a null source is a source of its own.  All columns stay as
    they came, whatever their names.
    """
    copies = materialize(mixing.copies_by_key(mixing.mix(docs.select("doc_id", "source", "text"))))
    return mixing.expand(docs, _side(copies))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens; null texts count as empty."""
    return packing.pack(packing.tokenize_pieces(docs, tokenizer_path())).drop("row")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trees, filters, iterations and packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
