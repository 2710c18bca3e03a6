"""The deduplicated corpus, the chunk map, and lookups of positives and relevance rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import corpus_id, record_identifier


def chunk_rows(records: DataFrame) -> DataFrame:
    """(file_identifier, chunk_id, text, rec_ord, chunk_pos) of the chunks with an id and a text."""
    keyed = records.select(record_identifier(F.col("source_id"), F.col("file_name")).alias("file_identifier"), "rec_ord", F.posexplode_outer("chunks").alias("chunk_pos", "c"))
    return keyed.where((F.col("c.chunk_id").isNotNull()) & (F.coalesce("c.text", F.lit("")) != "")).select("file_identifier", F.col("c.chunk_id").alias("chunk_id"), F.col("c.text").alias("text"), "rec_ord", "chunk_pos")


def corpus_of(rows: DataFrame) -> DataFrame:
    """(text, corpus_id, first_rec, first_pos) of the distinct texts, with where each is first."""
    first = rows.groupBy("text").agg(F.min(F.struct("rec_ord", "chunk_pos")).alias("f"))
    return first.select("text", corpus_id(F.col("text")).alias("corpus_id"), F.col("f.rec_ord").alias("first_rec"), F.col("f.chunk_pos").alias("first_pos"))


def chunk_map(rows: DataFrame) -> DataFrame:
    """(file_identifier, chunk_id, text): of chunks with one key the last counts."""
    return rows.groupBy("file_identifier", "chunk_id").agg(F.max_by("text", F.struct("rec_ord", "chunk_pos")).alias("text"))


def with_positives(pairs: DataFrame, mapping: DataFrame, max_positives: int | None = 5, need_one: bool = True) -> DataFrame:
    """Pairs whose segments all exist, with pos_ids, their texts' corpus ids in order, repeats kept.

    pairs has file_identifier, rec_ord, pair_pos, question and segment_ids.
    Pairs without a question, with more than max_positives segments, or (if
    need_one) without any, are left out.
    """
    asked = pairs.where(F.coalesce("question", F.lit("")) != "").withColumn("segment_ids", F.coalesce("segment_ids", F.array().cast("array<int>")))
    if max_positives is not None:
        asked = asked.where(F.size("segment_ids") <= max_positives)
    segments = asked.select("rec_ord", "pair_pos", "file_identifier", F.posexplode("segment_ids").alias("pos", "chunk_id"))
    found = segments.join(mapping.select("file_identifier", "chunk_id", corpus_id(F.col("text")).alias("id")), ["file_identifier", "chunk_id"], "left")
    whole = found.groupBy("rec_ord", "pair_pos").agg(F.bool_and(F.col("id").isNotNull()).alias("ok"), F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("l"))  # of a pair
    out = asked.join(whole, ["rec_ord", "pair_pos"], "inner" if need_one else "left").where(F.coalesce("ok", F.lit(True)))
    return out.withColumn("pos_ids", F.transform(F.coalesce("l", F.array()), lambda x: x["id"])).drop("ok", "l")


def relevance(positives: DataFrame, query_col: str = "query_id") -> DataFrame:
    """(query-id, corpus-id, score): a row for each positive, repeats kept."""
    return positives.select(F.col(query_col).alias("query-id"), F.explode("pos_ids").alias("corpus-id")).withColumn("score", F.lit(1))
