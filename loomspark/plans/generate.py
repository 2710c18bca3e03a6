"""Columns by plugins, prompts, and the four-column question pipeline over any model client."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import greedy_distinct, text_transform
from loomspark.operators.ordinals import with_ordinal
from loomspark.plans.config import GenerationConfig, PipelineConfig, as_mapping, producer_version
from loomspark.plans.export import write_provenance
from loomspark.schemas import ARTIFACT_KINDS, DOCUMENT_ARTIFACTS, QA_EVALUATIONS, QA_GENERATION, QA_PAIR
from loomspark.shipping import map_arrow
from loomspark.sources.files import count_seeds, seed_documents


class ModelClient(Protocol):
    """What a model must do; clients are sent to executors, so they must pickle."""

    def complete(self, prompts: list[str]) -> list[str]: ...

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class StubClient:
    """A model whose answers follow from the prompt alone, for tests and dry runs."""

    pairs: int = 7

    def complete(self, prompts: list[str]) -> list[str]:
        return [self._answer(p) for p in prompts]

    def _answer(self, prompt: str) -> str:
        kind, _, body = prompt.partition("\n")
        tag = hashlib.sha256(body.encode()).hexdigest()[:8]
        if kind.startswith("ARTIFACTS"):
            return json.dumps({k: [{"text": f"{k} {tag}", "description": "", "importance": "medium"}] for k in ARTIFACT_KINDS})
        if kind.startswith("PAIRS"):
            one = lambda i: {"question": f"What is {tag} {i}?", "answer": f"{i}", "question_complexity": 3, "query_type": "contextual", "reasoning_type": "factual", "segment_ids": [1], "hop_count": 1, "hop_contexts": []}
            return json.dumps({"pairs": [one(i) for i in range(self.pairs)]})
        n = body.count("\nQuestion ")
        mark = {"score": 8, "justification": ""}
        return json.dumps({"evaluations": [{"relevance": mark, "accuracy": mark, "context_support": mark, "clarity": mark, "overall": {"score": 8.0, "assessment": ""}, "improvements": ""}] * n})

    def embed(self, texts: list[str]) -> list[list[float]]:
        # 64 numbers: of random directions a pair has a cosine above 0.9 once in about 1e20 or more; 16 were too few for 50,000 documents
        return [[b / 255 - 0.5 for b in hashlib.sha512(t.encode()).digest()] for t in texts]


REGISTRY: dict[str, type] = {}


def plugin(name: str) -> Callable[[type], type]:
    """Registers a column plugin: a dataclass with name, required_columns() and apply(df, client)."""

    def add(kind: type) -> type:
        REGISTRY[name] = kind
        return kind

    return add


def check_plugins() -> list[str]:
    """What is wrong with registered plugins; none being registered is an error too."""
    wrong = [f"{n} lacks {m}" for n, k in REGISTRY.items() for m in ("apply", "required_columns") if not callable(getattr(k, m, None))]
    return wrong if REGISTRY else ["no plugin is registered"]


def answered(df: DataFrame, name: str, question: Column, kind: str, answers: Callable[[list], list], arrow: pa.DataType) -> DataFrame:
    """df with what answers gives for question, a list of which it gets for each Arrow batch."""
    asked = df.withColumn("_asked", question)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(answers(b.column(len(names)).to_pylist()), arrow)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], found], names=[*names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_arrow(asked, run, f"{fields}, `{name}` {kind}")


def structured(df: DataFrame, name: str, prompt: Column, schema: str, client: ModelClient) -> DataFrame:
    """df with a model's answers to prompt, parsed by schema; one call per Arrow batch. Answers that don't parse are null."""
    raw = answered(df.drop(name), "_answer", prompt, "string", client.complete, pa.string())
    return raw.withColumn(name, F.from_json("_answer", schema)).drop("_answer")


@plugin("llm-structured")
@dataclass(frozen=True)
class StructuredColumn:
    name: str
    prompt: Column
    schema: str
    needs: tuple[str, ...] = ()

    def required_columns(self) -> tuple[str, ...]:
        return self.needs

    def apply(self, df: DataFrame, client: ModelClient) -> DataFrame:
        return structured(df, self.name, self.prompt, self.schema, client)


@plugin("embedding-dedup")
@dataclass(frozen=True)
class EmbeddingDedup:
    """Items of a list whose texts aren't closer than threshold to one kept before."""

    name: str
    source: str
    items_key: str | None = None
    text_field: str = "question"
    threshold: float = 0.9

    def required_columns(self) -> tuple[str, ...]:
        return (self.source,)

    def apply(self, df: DataFrame, client: ModelClient) -> DataFrame:
        def embed(lists: list[list[str]]) -> list[list[list[float]]]:
            flat = [t for texts in lists for t in texts]
            found, out = iter(client.embed(flat) if flat else []), []
            for texts in lists:
                out.append([next(found) for _ in texts])
            return out

        items = F.coalesce(F.col(f"{self.source}.{self.items_key}" if self.items_key else self.source), F.array().cast(f"array<{QA_PAIR}>"))
        texts = F.transform(items, lambda x: F.coalesce(x[self.text_field].cast("string"), F.lit("")))
        vectors = answered(df.withColumn("_items", items), "_vectors", texts, "array<array<double>>", embed, pa.list_(pa.list_(pa.float64())))
        kept = F.transform(greedy_distinct(F.col("_vectors"), self.threshold), lambda i: F.get(F.col("_items"), i))
        return vectors.withColumn(self.name, kept).drop("_items", "_vectors")


@plugin("text-transform")
@dataclass(frozen=True)
class TextTransform:
    name: str
    source: str
    transform: str = "upper"
    drop: bool = False

    def required_columns(self) -> tuple[str, ...]:
        return (self.source,)

    def apply(self, df: DataFrame, client: ModelClient | None = None) -> DataFrame:
        out = df.withColumn(self.name, text_transform(F.col(self.source), self.transform))
        return out.drop(self.name) if self.drop else out


@dataclass(frozen=True)
class Buffered:
    """A client that is given so many prompts or texts at once at most."""

    client: ModelClient
    size: int

    def _parts(self, ask: Callable[[list], list], items: list) -> list:
        return [x for a in range(0, len(items), self.size) for x in ask(items[a : a + self.size])]

    def complete(self, prompts: list[str]) -> list[str]:
        return self._parts(self.client.complete, prompts)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return self._parts(self.client.embed, texts)


def run_columns(df: DataFrame, columns: list, client: ModelClient | None = None, buffer_size: int | None = None, processors: list[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """df with all columns, each once those it needs are there; a need that nothing gives is an error."""
    if client is not None and buffer_size:
        client = Buffered(client, buffer_size)
    waiting = list(columns)
    while waiting:
        ready = [c for c in waiting if set(c.required_columns()) <= set(df.columns)]
        if not ready:
            raise ValueError(f"columns needed but never made: {sorted({n for c in waiting for n in c.required_columns()} - set(df.columns))}")
        for c in ready:
            df = c.apply(df, client)
            waiting.remove(c)
    for p in processors or []:
        df = df.transform(p)
    return df


def artifacts_prompt(config: PipelineConfig) -> Column:
    head = f"ARTIFACTS up to {config.max_artifacts_per_type} of each: {', '.join(ARTIFACT_KINDS)}. Answer in JSON."
    return F.concat(F.lit(head + "\n"), F.col("text"))


def numbered_segments(chunks: str = "chunks") -> Column:
    """A record's chunks as lines of a prompt."""
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("Segment "), c["chunk_id"].cast("string"), F.lit(": "), c["text"])), "\n")


def pairs_prompt(config: PipelineConfig) -> Column:
    kinds = ", ".join(f"{n} {k}" for k, n in config.query_counts.items())
    ways = ", ".join(f"{n} {k}" for k, n in config.reasoning_counts.items())
    head = f"PAIRS {config.num_pairs} questions with answers: {kinds}; {ways}; {config.min_hops} to {config.max_hops} hops; complexity {config.min_complexity} to 5. Answer in JSON."
    return F.concat(F.lit(head + "\n"), F.array_join("sections_structured", "\n\n"), F.lit("\nFacts: "), F.coalesce(F.to_json("document_artifacts"), F.lit("{}")))


def evaluation_prompt() -> Column:
    pairs = F.array_join(F.transform("deduplicated_qa_pairs", lambda p, i: F.concat(F.lit("\nQuestion "), (i + 1).cast("string"), F.lit(": "), F.coalesce(p["question"], F.lit("")), F.lit("\nAnswer: "), F.coalesce(p["answer"], F.lit("")))), "")
    return F.concat(F.lit("EVALUATIONS one for each question, in order, scores from 1 to 10. Answer in JSON.\n"), numbered_segments(), pairs)


def question_columns(config: PipelineConfig) -> list:
    """The four columns: artifacts, pairs, pairs without near-repeats, evaluations."""
    return [
        StructuredColumn("document_artifacts", artifacts_prompt(config), DOCUMENT_ARTIFACTS, ("text",)),
        StructuredColumn("qa_generation", pairs_prompt(config), QA_GENERATION, ("sections_structured", "document_artifacts")),
        EmbeddingDedup("deduplicated_qa_pairs", "qa_generation", "pairs", "question", config.similarity_threshold),
        StructuredColumn("qa_evaluations", evaluation_prompt(), QA_EVALUATIONS, ("deduplicated_qa_pairs", "chunks")),
    ]


@dataclass(frozen=True)
class Generation:
    path: Path
    records: int
    skipped: int = 0
    facts: dict = field(default_factory=dict)


def seeds(spark: SparkSession, config: GenerationConfig) -> DataFrame:
    s = config.seed_source
    found = seed_documents(
        spark, s.path, extensions=list(s.file_extensions) if s.file_extensions else None, num_files=s.num_files, min_length=s.min_text_length, per_chunk=s.sentences_per_chunk,
        n_sections=s.num_sections, strategy=s.bundle_strategy, multi_doc=s.multi_doc, bundle_size=s.bundle_size, max_docs=s.max_docs_per_bundle, manifest=s.manifest,
    )
    chosen = found
    if config.start_index or config.end_index is not None:
        last = F.lit(True) if config.end_index is None else F.col("_n") <= config.end_index
        chosen = with_ordinal(found, ["file_name"], "_n").where((F.col("_n") >= config.start_index) & last).drop("_n")
    return chosen.orderBy("file_name").limit(config.num_records) if config.num_records else chosen


def check_amount(spark: SparkSession, config: GenerationConfig) -> int:
    """The number of records to be made; asking for more than there are seeds is an error."""
    s = config.seed_source
    there = count_seeds(spark, s.path, extensions=list(s.file_extensions) if s.file_extensions else None, num_files=s.num_files, multi_doc=s.multi_doc, bundle_size=s.bundle_size, max_docs=s.max_docs_per_bundle, manifest=s.manifest)
    if (config.num_records or 0) > there:
        raise ValueError(f"num_records is {config.num_records}; there are {there} seeds")
    return config.num_records or there


def dedup_outcome(records: DataFrame, source: str = "qa_generation.pairs", kept: str = "deduplicated_qa_pairs") -> DataFrame:
    """One row: items that near-duplicate removal has kept and removed."""
    sizes = records.select(F.coalesce(F.size(source), F.lit(0)).alias("a"), F.coalesce(F.size(kept), F.lit(0)).alias("b"))
    return sizes.agg(F.coalesce(F.sum("b"), F.lit(0)).alias("kept"), F.coalesce(F.sum(F.col("a") - F.col("b")), F.lit(0)).alias("removed"))


def preview(spark: SparkSession, config: GenerationConfig, client: ModelClient, n: int = 3) -> DataFrame:
    """A few seeds through the pipeline; nothing is stored."""
    return run_columns(seeds(spark, config).orderBy("file_name").limit(n), question_columns(config.pipeline), client)


def generate(spark: SparkSession, config: GenerationConfig, client: ModelClient) -> Generation:
    """Run the pipeline over all seeds and store records as JSON lines.

    With resume, seeds whose source_id has been stored are left out. No file
    has more than buffer_size records, and no model call more of their prompts.
    """
    path = Path(config.output_dir) / (config.dataset_name or "retrieval_sdg")
    check_amount(spark, config)
    todo, done = seeds(spark, config), 0
    exists = path.exists() and any(path.glob("*.json"))
    if exists and config.resume == "never":
        raise FileExistsError(f"{path} has records; resume, or choose another name")
    if exists:
        stored = spark.read.schema("source_id string").json(str(path)).select("source_id").distinct()
        done = stored.count()
        todo = todo.join(stored, "source_id", "left_anti")
    elif config.resume == "always":
        raise FileNotFoundError(f"{path} has nothing to resume")
    run_columns(todo, question_columns(config.pipeline), client, config.buffer_size).write.mode("append").option("maxRecordsPerFile", config.buffer_size).json(str(path))
    total = spark.read.schema("source_id string").json(str(path)).count()
    write_provenance(Path(config.output_dir) / ".runs" / path.name, as_mapping(config), {"records": total, "resumed": done, "producer": producer_version()})
    return Generation(path, total, done)
