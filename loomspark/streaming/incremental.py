"""An extension: chunks and corpus ids of files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspark.functions.text import chunk_pieces, corpus_id, piece_text, strip


def chunk_stream(spark: SparkSession, folder: str, per_chunk: int = 5, files_per_batch: int = 200) -> DataFrame:
    """A stream of (path, doc_chunk_index, text, corpus_id, arrived) over a folder's text files, files_per_batch at a time."""
    raw = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    found = raw.where(strip(F.col("value")) != "").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("arrived"), F.posexplode_outer(chunk_pieces(F.col("value"), per_chunk)).alias("i", "p"))
    return found.select("path", "arrived", (F.col("i") + 1).alias("doc_chunk_index"), piece_text(F.col("p")).alias("text")).withColumn("corpus_id", corpus_id(F.col("text")))


def distinct_chunks(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each corpus id once; ids are forgotten when they are later than the watermark allows, so state stays bounded."""
    return stream.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["corpus_id"])


def run_available(stream: DataFrame, target: str, checkpoint: str, processor: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Append all that has arrived to Parquet and stop; the checkpoint lets the next run go on from there.

    processor(df, batch number) changes each batch before it is stored.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if processor is None:
        return writer.format("parquet").option("path", target).start()

    def store(df: DataFrame, batch: int) -> None:
        processor(df, batch).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return writer.foreachBatch(store).start()
