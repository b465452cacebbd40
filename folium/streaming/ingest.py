"""Incremental ingest: new files as a stream, extracted and appended to a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from folium.sources import files as sources


def file_stream(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """Files that arrive below a path, as described rows."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)
    return sources.describe(raw).where("supported")


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written: any other trouble in reading it is not taken for its absence."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.exists(place) and any(s.getPath().getName().endswith(".parquet") for s in files.listStatus(place))


def ingest(spark: SparkSession, path: str, table: str, checkpoint: str, pdf=None, ocr=None, per_batch: int = 1000) -> StreamingQuery:
    """Append each batch's new documents (by content hash) to a Parquet table; starts and returns the query.

    A batch that is run again after a failure finds its hashes in the table and adds nothing twice.
    """

    def add(batch: DataFrame, _: int) -> None:
        rows = sources.extract(batch, pdf, ocr).withColumnRenamed("hash", "document_id").dropDuplicates(["document_id"])
        known = spark.read.parquet(table).select("document_id") if _there(spark, table) else None  # the first batch makes it
        fresh = rows if known is None else rows.join(known, "document_id", "left_anti")
        fresh.withColumn("ingested_at", F.current_timestamp()).write.mode("append").parquet(table)

    stream = file_stream(spark, path, per_batch)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
