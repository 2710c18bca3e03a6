"""Text directories as seed rows: a manifest of metadata first, contents only for what is left of it."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import matches_extensions, norm_path
from loomspark.operators.chunking import bundled_documents, bundles, single_documents

log = logging.getLogger(__name__)

#: Files of a listing that is broadcast at most.
LISTED = 500_000


def first_by_path(files: DataFrame, n: int) -> DataFrame:
    """The first n files in the order of their paths."""
    return files.orderBy("path").limit(n)


def listing(spark: SparkSession, root: str, pattern: str = "*", recursive: bool = True, extensions: list[str] | None = None, num_files: int | None = None) -> DataFrame:
    """(path, uri, length) of the files under root, by relative path; reads no contents. No file at all is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(root)
    base = F.lit(str(Path(root).resolve()) + "/") if "://" not in root else F.lit(root.rstrip("/") + "/")
    relative = F.element_at(F.split(F.col("uri"), F.concat(F.lit(r"\Q"), base, F.lit(r"\E"))), -1)
    out = files.select(F.col("path").alias("uri"), "length").withColumn("path", relative).where(matches_extensions(F.col("path"), extensions)).select("path", "uri", "length")
    if num_files is not None:
        out = first_by_path(out, num_files)
    if out.isEmpty():
        raise FileNotFoundError(f"no file under {root} matches")
    return out


def _glob(extensions: list[str] | None) -> str | None:
    """A glob for the names that have one of the extensions, whatever their case; none where names without a dot count too."""
    if not extensions or "" in extensions:
        return None
    return "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"


def texts(spark: SparkSession, files: DataFrame, root: str, min_length: int = 0, pattern: str = "*", extensions: list[str] | None = None) -> DataFrame:
    """files with text; what isn't UTF-8, or is shorter than min_length, has none.

    Contents are read only of files whose names fit pattern, or else have one
    of the extensions; they aren't shuffled as long as the listing is short.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    glob = pattern if pattern != "*" else _glob(extensions)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    contents = reader.load(root).select(F.col("path").alias("uri"), "content")
    text = F.when(F.is_valid_utf8(F.col("content")), F.decode(F.when(F.is_valid_utf8(F.col("content")), F.col("content")), "UTF-8"))
    few = files.limit(LISTED + 1).count() <= LISTED
    read = contents.join(F.broadcast(files) if few else files, "uri").withColumn("text", text).drop("content")
    read = read.select(*files.columns, "text")
    return read.withColumn("text", F.when(F.length("text") >= min_length, F.col("text"))) if min_length > 0 else read


def manifest_bundles(path: str) -> list[list[str]]:
    """Bundles of a JSON or YAML manifest: lists of lists, or {"bundles": [{"docs": [...]}]}; one that can't be read is empty."""
    try:
        raw = Path(path).read_text(encoding="utf-8")
        try:
            found = json.loads(raw)
        except json.JSONDecodeError:
            import yaml

            found = yaml.safe_load(raw)
        if isinstance(found, dict):
            found = [b.get("docs", []) if isinstance(b, dict) else b for b in found.get("bundles", [])]
        return [docs for b in found or [] if (docs := [str(d) for d in b or [] if d])]
    except Exception as e:  # noqa: BLE001  any unreadable manifest counts as none
        log.warning("manifest %s can't be read: %s", path, e)
        return []


def count_seeds(spark: SparkSession, root: str, *, multi_doc: bool = False, bundle_size: int = 2, max_docs: int = 3, manifest: str | None = None, **how) -> int:
    """The number of seed rows that a directory gives at most, without reading contents."""
    files = listing(spark, root, **how)
    if not multi_doc:
        return files.count()
    own = bundles(files.withColumn("path", norm_path(F.col("path"))), bundle_size, max_docs, _manifest(spark, manifest))
    return own.select("kind", "bundle").distinct().count()


def _manifest(spark: SparkSession, path: str | None) -> DataFrame | None:
    if not path:
        return None
    rows = [(b, i, p) for b, docs in enumerate(manifest_bundles(path)) for i, p in enumerate(docs)]
    return spark.createDataFrame(rows, "bundle long, pos int, path string")


def seed_documents(spark: SparkSession, root: str, *, pattern: str = "*", recursive: bool = True, extensions: list[str] | None = None, num_files: int | None = None, min_length: int = 0, per_chunk: int = 5, n_sections: int = 1, strategy: str = "sequential", multi_doc: bool = False, bundle_size: int = 2, max_docs: int = 3, manifest: str | None = None) -> DataFrame:
    """A directory's files, or bundles of them, as seed rows."""
    files = listing(spark, root, pattern, recursive, extensions, num_files)
    if not multi_doc:
        return single_documents(texts(spark, files, root, min_length, pattern, extensions), per_chunk, n_sections)
    own = bundles(files.withColumn("path", norm_path(F.col("path"))), bundle_size, max_docs, _manifest(spark, manifest))
    read = texts(spark, files, root, min_length, pattern, extensions).select(norm_path(F.col("path")).alias("path"), "text")
    keyed = own.withColumn("bundle", F.struct("kind", "bundle")).drop("kind")
    return bundled_documents(keyed.join(read, "path"), per_chunk, n_sections, strategy)
