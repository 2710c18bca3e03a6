"""Texts to sentence chunks, chunks to sections, files to bundles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.text import bundle_id, chunk_pieces, let, norm_path, piece_sentences, piece_text, source_id, strip, word_count
from loomspark.operators.ordinals import with_ordinal
from loomspark.schemas import CHUNK

BOUNDARY = "\n\n--- Document Boundary ---\n\n"


def chunks(text: Column, per_chunk: int = 5, doc_id: Column | None = None, doc_path: Column | None = None, offset: Column | int = 0, splitter: Callable[[Column], Column] | None = None) -> Column:
    """An array of chunks of per_chunk sentences, with 1-based ids and running word offsets.

    splitter turns a text into an array of sentences and may be replaced.
    """
    if per_chunk < 1:
        raise ValueError("a chunk needs a sentence at least")
    no_id = F.lit(None).cast("string")
    first = offset if isinstance(offset, Column) else F.lit(offset)

    def built(pieces: Column) -> Column:
        texts = F.transform(pieces, lambda p: F.struct(piece_text(p).alias("text"), piece_sentences(p).alias("sentences")))
        return let(F.transform(texts, lambda p: F.struct(p["text"].alias("text"), p["sentences"].alias("sentences"), word_count(p["text"]).alias("words"))), placed)

    def placed(counted: Column) -> Column:
        ends = F.aggregate(counted, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p["words"])))
        return let(ends, lambda e: F.transform(counted, lambda p, i: one(p, i, F.get(e, i))))

    def one(p: Column, i: Column, start: Column) -> Column:
        return F.struct(
            p["text"].alias("text"), start.alias("start"), (start + p["words"]).alias("end"), p["sentences"].alias("sentence_count"), p["words"].alias("word_count"),
            (i + 1 + first).cast("int").alias("chunk_id"), (i + 1).alias("doc_chunk_index"),
            (no_id if doc_id is None else doc_id).alias("doc_id"), (no_id if doc_path is None else doc_path).alias("doc_path"),
        ).cast(CHUNK)

    some = let(chunk_pieces(text, per_chunk, splitter), built)
    return F.when(strip(text) != "", some).when(text.isNotNull(), F.array().cast(f"array<{CHUNK}>"))


def exploded_chunks(docs: DataFrame, key: str, text_col: str = "text", per_chunk: int = 5) -> DataFrame:
    """(key, doc_chunk_index, text, sentence_count, word_count, start, end): the scalable form, a row per chunk.

    Word offsets come from a window over a document's own chunks.
    """
    # As an outer generator it isn't evaluated once more to filter out rows without chunks.
    pieces = F.posexplode_outer(chunk_pieces(F.col(text_col), per_chunk)).alias("i", "p")
    parts = docs.where(strip(F.col(text_col)) != "").select(key, pieces)
    parts = parts.select(key, (F.col("i") + 1).alias("doc_chunk_index"), piece_text(F.col("p")).alias("text"), piece_sentences(F.col("p")).alias("sentence_count"))
    parts = parts.withColumn("word_count", word_count(F.col("text")))
    end = F.sum("word_count").over(W.partitionBy(key).orderBy("doc_chunk_index").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    return parts.withColumn("end", end).withColumn("start", F.col("end") - F.col("word_count"))


def format_section(section: Column, number: Column) -> Column:
    """A section's text: a header and a line for each chunk that isn't blank; empty if all are."""
    shown = F.filter(section, lambda c: strip(c["text"]) != "")
    label = lambda c: F.when(c["doc_id"].isNotNull(), F.concat(F.lit(" [Doc: "), c["doc_id"], F.lit("]"))).otherwise("")
    lines = F.transform(shown, lambda c: F.concat(F.lit("Segment "), c["chunk_id"].cast("string"), label(c), F.lit(" (00:00:00 - 00:00:00): "), c["text"]))
    head = F.concat(F.lit("=== Section "), number.cast("string"), F.lit(" ==="))
    return F.when(F.size(shown) > 0, F.concat(head, F.lit("\n"), F.array_join(lines, "\n"))).otherwise("")


def sequential_sections(found: Column, n: int) -> Column:
    """n runs of equal length, the last with what remains; empty ones are left out and the others keep their numbers."""
    size = F.greatest(F.lit(1), F.floor(F.size(found) / n).cast("int"))
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: format_section(F.slice(found, i * size + 1, F.when(i == n - 1, F.greatest(F.size(found) - i * size, F.lit(0))).otherwise(size)), i + 1),
    )
    return F.filter(slots, lambda s: s != "")


def _documents(found: Column) -> Column:
    """Chunks by document, in order of first appearance; chunks without one share 'default'."""
    name = lambda c: F.coalesce(c["doc_id"], F.lit("default"))
    return F.transform(F.array_distinct(F.transform(found, name)), lambda d: F.filter(found, lambda c: name(c) == d))


def balanced_sections(found: Column, n: int) -> Column:
    """n sections with a share of each document each; sections without chunks aren't counted."""
    width = lambda d: F.greatest(F.lit(1), F.ceil(F.size(d) / n).cast("int"))

    def built(docs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.flatten(F.transform(docs, lambda d: F.slice(d, i * width(d) + 1, width(d)))))
        full = F.filter(parts, lambda p: F.size(p) > 0)
        made = F.filter(F.transform(full, lambda p, i: format_section(p, i + 1)), lambda s: s != "")
        return F.when(F.size(docs) <= 1, sequential_sections(found, n)).otherwise(made)

    return let(_documents(found), built)


def interleaved_sections(found: Column, n: int) -> Column:
    """Documents take turns chunk by chunk, then as sequential_sections."""

    def turns(docs: Column) -> Column:
        longest = F.greatest(F.array_max(F.transform(docs, F.size)), F.lit(1))
        dealt = F.flatten(F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.filter(F.transform(docs, lambda d: F.get(d, i)), lambda c: c.isNotNull())))
        return F.when(F.size(docs) <= 1, found).otherwise(dealt)

    return let(let(_documents(found), turns), lambda c: sequential_sections(c, n))


def sections(found: Column, n: int = 1, strategy: str = "sequential") -> Column:
    """By strategy: sequential, doc_balanced or interleaved; any other name is sequential."""
    return {"doc_balanced": balanced_sections, "interleaved": interleaved_sections}.get(strategy, sequential_sections)(found, n)


def bundles(files: DataFrame, size: int = 2, most: int = 3, manifest: DataFrame | None = None, path_col: str = "path") -> DataFrame:
    """(bundle, pos, path): the manifest's bundles (bundle, pos, path) first, then all other files, in order of path, size by size.

    Manifest entries that aren't files, or that an earlier bundle has, are
    dropped. A bundle of more than most members is an error when it is read.
    """
    files = files.select(F.col(path_col).alias("path")).distinct()
    taken = None
    if manifest is not None:
        known = manifest.withColumn("path", norm_path(F.col("path"))).join(files, "path", "left_semi")
        known = known.groupBy("path").agg(F.min(F.struct("bundle", "pos")).alias("f")).select("f.bundle", "f.pos", "path")
        taken = known
        files = files.join(known, "path", "left_anti")
    rest = with_ordinal(files, ["path"], "r")
    rest = rest.select(F.floor(F.col("r") / size).cast("long").alias("bundle"), (F.col("r") % size).cast("int").alias("pos"), "path", F.lit(1).alias("kind"))
    out = rest if taken is None else taken.select(F.col("bundle").cast("long"), F.col("pos").cast("int"), "path", F.lit(0).alias("kind")).union(rest)
    many = F.count("*").over(W.partitionBy("kind", "bundle"))
    text = F.concat(F.lit("a bundle has "), many.cast("string"), F.lit(f" documents; at most {most} are allowed"))
    return out.withColumn("_n", many).withColumn("path", F.when(many > most, F.raise_error(text).cast("string")).otherwise(F.col("path"))).drop("_n")


def bundled_documents(members: DataFrame, per_chunk: int = 5, n_sections: int = 1, strategy: str = "sequential") -> DataFrame:
    """A seed row for each bundle of (bundle, pos, path, text): chunks numbered through its members, sections, ids of the members that have a text."""
    some = members.where(F.col("text").isNotNull())
    some = some.withColumn("doc", chunks(F.col("text"), per_chunk, norm_path(F.col("path")), F.col("path")))
    own = some.groupBy("bundle").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "text", "doc"))).alias("m"))  # at most the cap's members
    flat = F.flatten(F.transform("m", lambda m: m["doc"]))
    numbered = F.transform(flat, lambda c, i: c.withField("chunk_id", i + 1)).cast(f"array<{CHUNK}>")
    paths = F.transform("m", lambda m: m["path"])
    out = own.select("bundle", paths.alias("file_name"), F.array_join(F.transform("m", lambda m: m["text"]), BOUNDARY).alias("text"), numbered.alias("chunks")).where("size(chunks) > 0")
    return out.select(
        "file_name", source_id(F.col("file_name")).alias("source_id"), "text", "chunks", sections(F.col("chunks"), n_sections, strategy).alias("sections_structured"),
        bundle_id(F.col("file_name")).alias("bundle_id"), F.col("file_name").alias("bundle_members"), F.lit(True).alias("is_multi_doc"),
    )


def single_documents(files: DataFrame, per_chunk: int = 5, n_sections: int = 1) -> DataFrame:
    """A seed row for each (path, text)."""
    some = files.where(F.col("text").isNotNull()).withColumn("chunks", chunks(F.col("text"), per_chunk)).where("size(chunks) > 0")
    own = F.array("path")
    return some.select(
        own.alias("file_name"), source_id(own).alias("source_id"), "text", "chunks", sections(F.col("chunks"), n_sections).alias("sections_structured"),
        F.lit("").alias("bundle_id"), own.alias("bundle_members"), F.lit(False).alias("is_multi_doc"),
    )
