"""Generated records to training and evaluation sets."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import record_identifier
from loomspark.operators.corpus import chunk_map, chunk_rows, corpus_of, with_positives
from loomspark.operators.curation import retention, scored_pairs, skipped
from loomspark.operators.ordinals import with_ordinal
from loomspark.operators.splits import split
from loomspark.plans.config import ConversionConfig, as_mapping, producer_version
from loomspark.plans.export import write_corpus, write_evaluation_set, write_provenance, write_training_set
from loomspark.sources.records import load_groups, load_records
from loomspark.storage import releasing, written

log = logging.getLogger(__name__)

#: Skipped files that are named in the log at most.
SHOWN = 20


@dataclass(frozen=True)
class Conversion:
    folder: Path
    train: int
    val: int
    eval: int
    corpus: int


def keyed_pairs(records: DataFrame, threshold: float) -> DataFrame:
    pairs = scored_pairs(records, threshold)
    return pairs.withColumn("file_identifier", record_identifier(F.col("source_id"), F.col("file_name")))


def convert(spark: SparkSession, config: ConversionConfig) -> Conversion:
    """Run a conversion; provenance is written last, so that it marks success.

    The corpus and the pairs are stored once and feed all outputs. The
    evaluation set has the whole corpus and the test pairs, or with eval_only
    all pairs.
    """
    with releasing(spark):
        return _converted(spark, config)


def _converted(spark: SparkSession, config: ConversionConfig) -> Conversion:
    folder = config.folder()
    records = written(load_records(spark, config.input_path), "records")
    rows = chunk_rows(records)
    corpus = written(with_ordinal(corpus_of(rows), ["first_rec", "first_pos"]), "corpus")
    mapping = written(chunk_map(rows), "chunks")
    pairs = keyed_pairs(records, config.quality_threshold)
    if config.eval_only:
        placed = pairs.withColumn("split", F.lit("test"))
    else:
        groups = load_groups(spark, list(config.groups_json)) if config.groups_json else None
        placed = split(pairs, config.split_strategy, groups, train=config.train_ratio, val=config.val_ratio, seed=config.seed)
    placed = written(placed, "pairs")
    counts = {"train": 0, "val": 0}
    if not config.eval_only:
        for part in counts:
            kept = with_positives(placed.where(F.col("split") == part), mapping, config.max_pos_docs, True)
            kept = with_ordinal(kept, ["rec_ord", "pair_pos"])
            counts[part] = write_training_set(kept, folder / f"{part}.json", config.corpus_id, "./corpus")
        write_corpus(corpus, folder / "corpus", config.corpus_id)
    asked = with_positives(placed.where(F.col("split") == "test"), mapping, None, False)
    queries = written(with_ordinal(asked, ["rec_ord", "pair_pos"]), "queries")
    write_evaluation_set(queries, corpus, folder / "eval_beir", config.use_group_id_in_eval)
    totals = retention(records, config.quality_threshold).first().asDict()
    out = Conversion(folder, counts["train"], counts["val"], queries.count(), corpus.count())
    names = [r["file_name"] for r in skipped(records).select(F.to_json("file_name").alias("file_name")).limit(SHOWN).collect()]
    log.info("%s: %s pairs, %s kept (%.1f %%), %s files skipped%s; train %s, val %s, eval %s, corpus %s", folder, totals["total"], totals["remaining"], totals["retention"], totals["skipped_files"], f", such as {names}" if names else "", out.train, out.val, out.eval, out.corpus)
    write_provenance(folder / ".run", as_mapping(config), totals | {"producer": producer_version(), "train": out.train, "val": out.val, "eval": out.eval, "corpus": out.corpus})
    return out
