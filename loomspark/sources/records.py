"""Generated records, duplicate groups, evaluation files and package lists."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.text import file_names, norm_path
from loomspark.operators.curation import consistent
from loomspark.operators.ordinals import with_ordinal
from loomspark.operators.registry import package_row_errors, sorted_package_list
from loomspark.schemas import CATALOG, PACKAGE_LIST, RECORD
from loomspark.shipping import ship

_FORMATS = {".json": "json", ".jsonl": "jsonl", ".parquet": "parquet"}


def record_files(path: str) -> tuple[str, list[str]]:
    """The format and files of a path: the file itself, or a directory's files of one format; several formats are an error.

    In a directory, generated_batch*.json stand for all other .json files.
    """
    place = Path(path)
    if place.is_file():
        if place.suffix.lower() not in _FORMATS:
            raise ValueError(f"not a record file: {path}")
        return _FORMATS[place.suffix.lower()], [path]
    found = {f: sorted(str(p) for p in place.iterdir() if p.suffix.lower() == s) for s, f in _FORMATS.items()}
    batches = [p for p in found["json"] if Path(p).name.startswith("generated_batch")]
    found["json"] = batches or found["json"]
    present = [f for f in found if found[f]]
    if len(present) != 1:
        raise ValueError(f"{path} has record files of {len(present)} formats; one is needed")
    return present[0], found[present[0]]


def load_records(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Records of a file or directory with file_name as an array, a normalised source_id, and rec_ord, their order.

    With check, records with as many evaluations as pairs only.
    """
    kind, files = record_files(path)
    if kind == "jsonl":
        lines = spark.read.text(files).select("value", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i")).where(F.trim("value") != "")
        whole = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{_fields()}>>")).otherwise(F.array(F.from_json("value", f"struct<{_fields()}>")))
        raw = lines.select("_f", "_i", F.posexplode(whole).alias("_k", "r")).select("_f", "_i", "_k", "r.*")
    elif kind == "json":
        raw = spark.read.option("multiLine", True).schema(RECORD).json(files).select("*", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i"), F.lit(0).alias("_k"))
    else:
        raw = spark.read.parquet(*files).select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_i"), F.lit(0).alias("_k"))
    names = F.col("file_name") if dict(raw.dtypes)["file_name"].startswith("array") else file_names(F.col("file_name"))
    has_source = "source_id" in raw.columns
    source = F.when(F.coalesce("source_id", F.lit("")) != "", norm_path(F.col("source_id"))) if has_source else F.lit(None).cast("string")
    out = with_ordinal(raw.withColumns({"file_name": names, "source_id": source}), ["_f", "_i", "_k"], "rec_ord").drop("_f", "_i", "_k")
    return consistent(out) if check else out


def _fields() -> str:
    return ",".join(part.replace(" ", ":", 1) for part in RECORD.split(", "))


def load_groups(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(group_id, doc_id, pos) of duplicate-group files: kinds exact, fuzzy and semantic, each with groups or clusters; a later group of one id overwrites."""
    one = "struct<groups:map<string,array<string>>,clusters:map<string,array<string>>>"
    raw = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("f"), F.from_json("value", f"exact {one}, fuzzy {one}, semantic {one}").alias("g"))
    order = F.lit(None).cast("int")
    for i, p in enumerate(paths):  # by the whole path, as files in different folders may share a name
        order = F.when(F.col("f").endswith(("/" + str(Path(p).resolve()).lstrip("/")) if "://" not in p else p), i).otherwise(order)
    raw = raw.withColumn("n", order)
    kinds = F.array(*[F.coalesce(f"g.{k}.groups", f"g.{k}.clusters") for k in ("exact", "fuzzy", "semantic")])
    each = raw.select("n", F.posexplode(kinds).alias("k", "m")).where("m is not null").select("n", "k", F.explode("m").alias("group_id", "docs"))
    last = each.groupBy("group_id").agg(F.max_by("docs", F.struct("n", "k")).alias("docs"))
    return last.select("group_id", F.posexplode("docs").alias("pos", "doc_id"))


def load_relevance(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, corpus_id, score, ord) of a tab-separated file; header names may have stray spaces."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    return raw.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("corpus_id"), F.col("score").cast("int").alias("score"), F.monotonically_increasing_id().alias("ord"))


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("_id string, text string, title string, group_id string").json(path).withColumn("line_ord", F.monotonically_increasing_id())


def load_splits(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, modality, load_ord) of a JSON file of query ids by modality."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    return spark.createDataFrame([(q, m, i) for i, (m, ids) in enumerate(found.items()) for q in ids], "query_id string, modality string, load_ord int")


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).schema(CATALOG).json(path)


def load_package_list(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a package list, in the order of package, version and file name; a file that doesn't exist has none.

    A line that is no JSON object, or breaks a rule of package lists, is an
    error that names the path and the line, raised when it is read.
    """
    if "://" not in path and not Path(path).exists():
        return spark.createDataFrame([], PACKAGE_LIST)
    lines = with_ordinal(spark.read.text(path).withColumn("_i", F.monotonically_increasing_id()), ["_i"], "n")
    lines = lines.where(F.trim("value") != "").withColumn("r", F.from_json("value", PACKAGE_LIST + ", _corrupt_record string"))
    broken = F.when(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull() | ~F.ltrim("value").startswith("{"), F.lit("is not a JSON object"))
    wrong = F.coalesce(broken, F.array_join(package_row_errors("r.filename", "r.hash", "r.requires_python"), ", "))
    text = F.concat(F.lit(f"{path}:"), (F.col("n") + 1).cast("string"), F.lit(" "), wrong)
    name = F.when(wrong != "", F.raise_error(text).cast("string")).otherwise(F.col("r.filename"))
    ship(spark)
    return sorted_package_list(lines.select(name.alias("filename"), F.col("r.hash").alias("hash"), F.col("r.requires_python").alias("requires_python")))


def distributions(spark: SparkSession, folder: str) -> DataFrame:
    """Package-list rows of a folder's wheels and source archives, hashed, with what their metadata requires of Python."""
    import io
    import tarfile
    import zipfile

    @F.pandas_udf("string")
    def requires(content: pd.Series, name: pd.Series) -> pd.Series:
        def one(data, file):
            try:
                if file.endswith(".whl"):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        text = z.read(next(n for n in z.namelist() if n.endswith(".dist-info/METADATA"))).decode()
                else:
                    with tarfile.open(fileobj=io.BytesIO(data)) as t:
                        member = next(m for m in t.getmembers() if m.name.count("/") == 1 and m.name.endswith("/PKG-INFO"))
                        text = t.extractfile(member).read().decode()
            except Exception:  # noqa: BLE001  an archive without readable metadata requires nothing
                return None
            return next((x.split(":", 1)[1].strip() for x in text.split("\n\n")[0].splitlines() if x.lower().startswith("requires-python:")), None)

        return pd.Series([one(d, f) for d, f in zip(content, name)])

    files = spark.read.format("binaryFile").load(folder).withColumn("filename", F.regexp_extract("path", r"([^/]*)$", 1)).where(F.col("filename").rlike(r"\.(whl|tar\.gz)$"))
    return files.select("filename", F.concat(F.lit("sha256="), F.sha2("content", 256)).alias("hash"), requires("content", "filename").alias("requires_python"))
