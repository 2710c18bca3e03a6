"""Integrity and quality filters, postprocessing and modality votes over generated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.operators.ordinals import with_ordinal
from loomspark.schemas import HOP_CONTEXT

PAIR_FIELDS = ("question", "answer", "question_complexity", "query_type", "reasoning_type", "segment_ids", "hop_count", "hop_contexts")


def _length(array: Column | str) -> Column:
    return F.coalesce(F.size(array), F.lit(0))


def pairs_of(generated: str = "qa_generation", distinct: str = "deduplicated_qa_pairs") -> Column:
    """A record's deduplicated pairs if it has that list, else those generated."""
    return F.coalesce(F.col(distinct), F.col(f"{generated}.pairs"))


def scores_of(evaluations: Column) -> Column:
    """Overall scores of an evaluation list; missing ones are 0."""
    return F.transform(F.coalesce(evaluations, F.array()), lambda e: F.coalesce(e["overall"]["score"], F.lit(0.0)))


def consistent(records: DataFrame) -> DataFrame:
    """Records with as many evaluations as deduplicated pairs."""
    return records.where(F.greatest(_length("qa_evaluations.evaluations"), F.lit(0)) == F.greatest(_length("deduplicated_qa_pairs"), F.lit(0)))


def scored_pairs(records: DataFrame, threshold: float = 7.0) -> DataFrame:
    """A row for each pair with a score of threshold at least: the pair's fields, file_name, source_id, rec_ord, pair_pos, quality_score.

    Records whose lists differ in length give nothing; see skipped().
    """
    scores = scores_of(F.col("qa_evaluations.evaluations"))
    keyed = records.withColumns({"_p": pairs_of(), "_s": scores}).where((_length("_p") > 0) & (F.size("_p") == F.size("_s")))
    zipped = keyed.select("file_name", "source_id", "rec_ord", F.posexplode(F.arrays_zip("_p", "_s")).alias("pair_pos", "z"))
    zipped = zipped.where(F.col("z._s") >= threshold)
    return zipped.select("file_name", "source_id", "rec_ord", "pair_pos", *[F.col(f"z._p.{f}").alias(f) for f in PAIR_FIELDS], F.col("z._s").alias("quality_score"))


def skipped(records: DataFrame) -> DataFrame:
    """file_name of the records that scored_pairs skips for lists of different length."""
    scores = scores_of(F.col("qa_evaluations.evaluations"))
    return records.withColumns({"_p": pairs_of(), "_s": scores}).where((_length("_p") > 0) & (F.size("_p") != F.size("_s"))).select("file_name")


def retention(records: DataFrame, threshold: float = 7.0) -> DataFrame:
    """One row: total, filtered, remaining, skipped_files, retention percent."""
    scores = scores_of(F.col("qa_evaluations.evaluations"))
    keyed = records.select(pairs_of().alias("p"), scores.alias("s")).where(_length("p") > 0)
    same = F.size("p") == F.size("s")
    good = F.size(F.filter("s", lambda x: x >= threshold))
    sums = keyed.agg(
        F.coalesce(F.sum(F.when(same, F.size("p"))), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(same, good)), F.lit(0)).alias("remaining"),
        F.count_if(~same).alias("skipped_files"),
    )
    return sums.select("total", (F.col("total") - F.col("remaining")).alias("filtered"), "remaining", "skipped_files", F.coalesce(F.try_divide(F.col("remaining") * 100.0, F.col("total")), F.lit(0.0)).alias("retention"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """(column, count, percent) by value."""
    total = df.count()
    return df.groupBy(column).agg(F.count("*").alias("count")).withColumn("percent", F.col("count") * 100.0 / max(total, 1))


def postprocessed(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, relevance rows and (modality, query_id) of all pairs with a question, numbered q00000000 on."""
    pairs = records.where(_length(pairs_of()) > 0).select("file_name", "rec_ord", F.posexplode(pairs_of()).alias("pair_pos", "p"))
    pairs = pairs.where(F.coalesce("p.question", F.lit("")) != "")
    numbered = with_ordinal(pairs, ["rec_ord", "pair_pos"], "n").withColumn("query_id", F.format_string("q%08d", "n"))
    hops = F.coalesce("p.hop_contexts", F.array().cast(f"array<{HOP_CONTEXT}>"))
    metadata = F.struct(
        F.coalesce("p.query_type", F.lit("")).alias("query_type"), F.coalesce("p.reasoning_type", F.lit("")).alias("reasoning_type"),
        F.coalesce("p.question_complexity", F.lit(0)).alias("question_complexity"), F.coalesce("p.hop_count", F.lit(1)).alias("hop_count"),
        F.coalesce("p.segment_ids", F.array().cast("array<int>")).alias("segment_ids"), F.coalesce("p.answer", F.lit("")).alias("answer"), F.when(F.size(hops) > 0, hops).alias("hop_contexts"),
    )
    queries = numbered.select("query_id", F.col("p.question").alias("text"), metadata.alias("metadata"))
    relevance = numbered.select(F.col("query_id").alias("query-id"), F.to_json("file_name").alias("corpus-id"), F.lit(1).alias("score"))
    return queries, relevance, numbered.select(F.lit("text").alias("modality"), "query_id")


def modality_votes(relevance: DataFrame, splits: DataFrame, ordinal: str = "ord") -> DataFrame:
    """(corpus_id, modality, modalities): each document's most frequent modality over its queries; of equals the one met first by ordinal.

    relevance has query_id, corpus_id and ordinal; splits has query_id, modality and load_ord, a later one overwriting.
    """
    last = splits.groupBy("query_id").agg(F.max_by("modality", "load_ord").alias("modality"))
    counts = relevance.join(last, "query_id").groupBy("corpus_id", "modality").agg(F.count("*").alias("n"), F.min(ordinal).alias("first"))
    return counts.groupBy("corpus_id").agg(F.max_by("modality", F.struct("n", -F.col("first"))).alias("modality"), F.array_sort(F.collect_set("modality")).alias("modalities"))  # of a document


def positive_documents(votes: DataFrame, corpus: DataFrame, min_length: int = 0) -> DataFrame:
    """(doc_id, text, title, modality, group_id) of the first corpus row of each voted group; corpus has _id, text, title, group_id and line_ord."""
    keyed = corpus.withColumn("group_id", F.coalesce("group_id", "_id"))
    first = keyed.groupBy("group_id").agg(F.min_by(F.struct("_id", "text", "title"), "line_ord").alias("d"))
    out = votes.withColumnRenamed("corpus_id", "group_id").join(first, "group_id")
    out = out.select(F.col("d._id").alias("doc_id"), F.col("d.text").alias("text"), F.coalesce("d.title", F.lit("")).alias("title"), "modality", "group_id")
    return out.where(F.length("text") >= min_length) if min_length > 0 else out
