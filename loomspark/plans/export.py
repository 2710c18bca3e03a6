"""Training sets, evaluation sets and run provenance."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_atomic(path: Path, pieces: Iterator[str]) -> None:
    """A file that is there whole or not at all."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as out:
            out.writelines(pieces)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_lines(lines: DataFrame, path: Path, head: str = "", tail: str = "", merge: bool = True) -> None:
    """A one-column table, in its order, as a text file, between head and tail.

    Tasks write the parts; merge joins their bytes to one file, as the formats
    want it, and without it the parts stay as a folder of that name, without
    head and tail. Rows never pass through the driver.
    """
    path.parent.mkdir(parents=True, exist_ok=True)
    parts = path.with_name(f".{path.name}-{uuid.uuid4().hex}")
    lines.write.text(str(parts))
    if not merge:
        shutil.rmtree(path, ignore_errors=True)
        parts.rename(path)
        return
    handle, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(head.encode())
            for part in sorted(parts.glob("part-*")):
                with open(part, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 22)
            out.write(tail.encode())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    finally:
        shutil.rmtree(parts, ignore_errors=True)


def training_item(corpus: str) -> Column:
    """A training example as JSON, of ordinal, question and pos_ids."""
    return F.to_json(F.struct(
        F.concat(F.lit("q"), F.col("ordinal").cast("string")).alias("question_id"), "question", F.lit(corpus).alias("corpus_id"),
        F.transform("pos_ids", lambda x: F.struct(x.alias("id"))).alias("pos_doc"), F.array().cast("array<string>").alias("neg_doc"),
    ))


def write_training_set(rows: DataFrame, path: Path, corpus: str, corpus_path: str) -> int:
    """train.json or val.json, one document; rows has ordinal (from 0), question and pos_ids."""
    item = F.when(F.col("ordinal") == 0, training_item(corpus)).otherwise(F.concat(F.lit(","), training_item(corpus)))
    write_lines(rows.orderBy("ordinal").select(item), path, '{"corpus": ' + json.dumps({"path": corpus_path}) + ', "data": [\n', "]}\n")
    return rows.count()


def write_corpus(corpus: DataFrame, folder: Path, name: str) -> None:
    """(id, text) in first-seen order as Parquet, and what the corpus is."""
    corpus.orderBy("first_rec", "first_pos").select(F.col("corpus_id").alias("id"), "text").write.mode("overwrite").parquet(str(folder / "train.parquet"))
    write_atomic(folder / "merlin_metadata.json", iter([json.dumps({"corpus_id": name, "class": "TextQADataset"})]))


def write_evaluation_set(queries: DataFrame, corpus: DataFrame, folder: Path, group_ids: bool = False, merge: bool = True) -> None:
    """corpus.jsonl (all of the corpus), queries.jsonl and qrels/test.tsv.

    queries has ordinal, question, pos_ids and the pair's fields; corpus has
    ordinal, text and corpus_id. Documents are d0, d1 and so on, or with
    group_ids their content ids. Without merge each is a folder of parts.
    """
    doc = F.col("corpus_id") if group_ids else F.concat(F.lit("d"), F.col("ordinal").cast("string"))
    named = corpus.withColumn("_id", doc)
    fields = [F.col("_id"), F.from_json(F.lit("{}"), "map<string,string>").alias("metadata"), F.col("text"), F.lit("").alias("title")]
    if group_ids:
        fields.append(F.col("corpus_id").alias("group_id"))
    write_lines(named.orderBy("ordinal").select(F.to_json(F.struct(*fields))), folder / "corpus.jsonl", merge=merge)
    kept = ["query_type", "reasoning_type", "hop_count", "question_complexity", "quality_score", "answer", "hop_contexts", "file_name", "segment_ids"]
    query = F.concat(F.lit("q"), F.col("ordinal").cast("string"))
    line = F.to_json(F.struct(query.alias("_id"), F.struct(*kept).alias("metadata"), F.col("question").alias("text")))
    write_lines(queries.orderBy("ordinal").select(line), folder / "queries.jsonl", merge=merge)
    places = named.select(F.col("corpus_id").alias("pos_id"), "_id")
    rows = queries.select("ordinal", query.alias("q"), F.posexplode("pos_ids").alias("pos", "pos_id")).join(places, "pos_id").orderBy("ordinal", "pos")
    write_lines(rows.select(F.concat_ws("\t", "q", "_id", F.lit("1"))), folder / "qrels" / "test.tsv", "query-id\tcorpus-id\tscore\n", merge=merge)


def write_provenance(folder: Path, config: dict, facts: dict) -> None:
    """The redacted configuration and facts of a run, written once it has succeeded."""
    import yaml

    from loomspark.plans.config import redacted

    write_atomic(folder / "config.yaml", iter([yaml.safe_dump(redacted(config), sort_keys=False)]))
    write_atomic(folder / "run.json", iter([json.dumps(facts, indent=2, sort_keys=True, default=str)]))
