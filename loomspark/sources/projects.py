"""Plugin packages of a repository as a relation, and the repository's catalog settings."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.code import docs_slug, owner_tokens
from loomspark.shipping import map_arrow

PROJECT = "package string, version string, description string, license string, readme string, authors array<string>, requires_python string, dependencies array<string>, entry_points map<string,string>, error string"


def _text(value) -> str | None:
    """A field of text, or a table or list that holds something, as text."""
    return None if value in (None, "", [], {}) else str(value)


def _project(raw: bytes, group: str) -> tuple:
    try:
        found = tomllib.loads(raw.decode("utf-8")).get("project")
        if not isinstance(found, dict):
            return (*[None] * 9, "no project table")
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        return (*[None] * 9, f"not TOML: {e}")
    points = found.get("entry-points", {})
    points = points.get(group, {}) if isinstance(points, dict) else {}
    return (
        _text(found.get("name")), _text(found.get("version")), _text(found.get("description")), _text(found.get("license")), _text(found.get("readme")),
        [str(a) for a in found.get("authors", []) or []], _text(found.get("requires-python")), [str(d) for d in found.get("dependencies", []) or []],
        [(str(k), str(v)) for k, v in sorted(points.items())], None,
    )


def projects(spark: SparkSession, plugins: str, group: str) -> DataFrame:
    """A row for each */pyproject.toml under plugins: folder, the columns of PROJECT, owners (of its CODEOWNERS), docs_slug and has_docs.

    entry_points are those of group. A file that can't be read has an error.
    """
    kinds = pa.schema([
        *[pa.field(n, pa.string()) for n in ("folder", "package", "version", "description", "license", "readme")], pa.field("authors", pa.list_(pa.string())),
        pa.field("requires_python", pa.string()), pa.field("dependencies", pa.list_(pa.string())), pa.field("entry_points", pa.map_(pa.string(), pa.string())), pa.field("error", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(folder, *_project(content, group)) for folder, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.types)] if rows else [pa.array([], k) for k in kinds.types], names=kinds.names)

    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "pyproject.toml").load(f"{plugins}/*/").select(folder, "content")
    found = map_arrow(files, run, f"folder string, {PROJECT}")
    if any(Path(plugins).glob("*/CODEOWNERS")):
        owned = spark.read.option("wholetext", True).option("pathGlobFilter", "CODEOWNERS").text(f"{plugins}/*/")
        owners = owned.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("folder"), owner_tokens(F.col("value")).alias("owners"))
        found = found.join(F.broadcast(owners), "folder", "left")
    else:
        found = found.withColumn("owners", F.lit(None).cast("array<string>"))
    with_docs = [p.parent.name for p in Path(plugins).glob("*/docs") if p.is_dir()]
    slug = docs_slug(F.coalesce("package", "folder"))
    return found.withColumns({"owners": F.coalesce("owners", F.array().cast("array<string>")), "docs_slug": slug, "has_docs": F.col("folder").isin(with_docs) if with_docs else F.lit(False)})


def repeated_slugs(found: DataFrame) -> DataFrame:
    """(docs_slug, packages) where several packages would share a documentation folder."""
    return found.groupBy("docs_slug").agg(F.array_sort(F.collect_list(F.coalesce("package", "folder"))).alias("packages")).where(F.size("packages") > 1)  # of one slug


@dataclass(frozen=True)
class CatalogSettings:
    """A repository's catalog settings."""

    catalog_url: str
    repository_url: str
    docs_base_url: str
    package_prefix: str
    package_index_url: str
    package_assets_url: str
    package_assets_release_tag: str
    default_requirement: str
    author_name: str
    repository_git_url: str | None = None
    release_ref_template: str | None = None

    def __post_init__(self):
        for name in ("catalog_url", "repository_url", "docs_base_url", "package_index_url", "package_assets_url", "repository_git_url"):
            value = getattr(self, name)
            if value is not None and not value.startswith(("http://", "https://")):
                raise ValueError(f"{name} must be an http address")
        if not any(c in self.default_requirement for c in "<>=~"):
            raise ValueError("default_requirement needs a version")
        if self.release_ref_template is not None:
            try:
                self.release_ref_template.format(package="p", version="v")
            except (KeyError, IndexError, ValueError) as e:
                raise ValueError("release_ref_template may only use {package} and {version}") from e

    def package_name(self, slug: str) -> str:
        return f"{self.package_prefix}{slug}"

    def docs_url(self, path: str = "") -> str:
        return f"{self.docs_base_url.rstrip('/')}/{path.lstrip('/')}"

    def install(self, package: str) -> dict[str, str]:
        return {"requirement": package, "index_url": self.package_index_url}

    def release_ref(self, package: str, version: str) -> str:
        if self.release_ref_template is None:
            raise ValueError("there is no release_ref_template")
        return self.release_ref_template.format(package=package, version=version)


def catalog_settings(path: str, *table: str, aliases: dict[str, str] | None = None) -> CatalogSettings:
    """The settings in a TOML file's table; hyphens stand for underscores, and aliases rename keys."""
    found = tomllib.loads(Path(path).read_text(encoding="utf-8"))
    for step in table:
        found = found.get(step) if isinstance(found, dict) else None
    if not isinstance(found, dict):
        raise ValueError(f"{path} has no table {'.'.join(table)}")
    values = {(aliases or {}).get(k, k).replace("-", "_"): v for k, v in found.items()}
    for name, f in CatalogSettings.__dataclass_fields__.items():
        if (name in values or f.default is not None) and not (isinstance(values.get(name), str) and values[name]):
            raise ValueError(f"{path} needs a text for {name}")
    return CatalogSettings(**{k: v for k, v in values.items() if k in CatalogSettings.__dataclass_fields__})


def catalog_rows(found: DataFrame, settings: CatalogSettings, distribution: str) -> DataFrame:
    """The catalog entries that packages give: a row for each entry point, as catalog_entries() has them."""
    from loomspark.functions.code import requirement_parts, version_specifier

    host = F.element_at(F.filter(F.transform("dependencies", lambda d: F.struct(d.alias("text"), requirement_parts(d).alias("r"))), lambda x: x["r"]["name"] == distribution), 1)
    rows = found.where("error is null").withColumn("host", F.when(F.exists("dependencies", lambda d: requirement_parts(d)["name"] == distribution), host))
    url = F.concat(F.lit(settings.docs_url("plugins/")), "docs_slug", F.lit("/"))
    return rows.select(
        F.lit(2).alias("schema_version"), "package", "version", "description", F.col("package").alias("requirement"), F.lit(settings.package_index_url).alias("index_url"),
        version_specifier(F.col("requires_python")).alias("python"), url.alias("docs_url"), F.col("host.text").alias("host_requirement"), F.col("host.r.specifier").alias("host_specifier"), F.col("host.r.marker").alias("host_marker"),
        F.concat(F.lit("plugins/"), "folder").alias("repository_path"), F.explode("entry_points").alias("entry_name", "entry_value"),
    ).orderBy("package", "entry_name")


def bumped(text: str, part: str) -> tuple[str, str]:
    """A pyproject.toml with the next version in its first version line, and that version; other versions than x.y.z are an error."""
    import re

    m = re.search(r'(version\s*=\s*")([^"]+)(")', text)
    numbers = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)", m[2]) if m else None
    if not numbers:
        raise ValueError("there is no version of the form x.y.z")
    major, minor, patch = map(int, numbers.groups())
    new = {"major": f"{major + 1}.0.0", "minor": f"{major}.{minor + 1}.0", "patch": f"{major}.{minor}.{patch + 1}"}[part]
    return text[: m.start(2)] + new + text[m.end(2) :], new
