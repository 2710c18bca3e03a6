"""Git repositories as a row per code file."""

from __future__ import annotations

import re
import shutil
import subprocess
import uuid
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.code import DEFAULT_EXCLUDES, LANGUAGES, LANGUAGES_BY_NAME, REPOSITORY, code_language, glob_to_regex, matches_any_glob
from loomspark.functions.text import base_name, suffix
from loomspark.storage import shared_folder

COLUMNS = ("repo_id", "repo_url", "commit_sha", "source_kind", "repository_path", "source_path", "relative_path", "file_name", "file_extension", "code_lang", "size_bytes", "content_sha256", "content")


_CLONES: dict[str, list[str]] = {}


class RepositoryError(RuntimeError):
    """A repository can't be read."""


@dataclass(frozen=True)
class Repository:
    repo_id: str
    repo_url: str | None
    root: str
    source_kind: str
    commit_sha: str | None


def git(*args: str, cwd: str | None = None, timeout: int = 300) -> str:
    try:
        done = subprocess.run(["git", *args], cwd=cwd, timeout=timeout, capture_output=True, text=True, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise RepositoryError(f"git {args[0]}: {e}") from e
    if done.returncode:
        raise RepositoryError(f"git {args[0]}: {done.stderr.strip()}")
    return done.stdout.strip()


def _ask(root: str, *args: str) -> str | None:
    try:
        return git(*args, cwd=root) or None
    except RepositoryError:
        return None


def github_name(spec: str) -> str:
    """owner/name of a short name or a github.com address."""
    spec = spec.strip()
    parts = urlsplit(spec)
    if parts.scheme in ("http", "https"):
        name = parts.path.strip("/").removesuffix(".git") if parts.netloc.lower() == "github.com" else ""
    else:
        name = spec.removeprefix("git@github.com:").removesuffix(".git").strip("/")
    if not re.match(REPOSITORY, name):
        raise ValueError(f"not a GitHub repository: {spec}")
    return name


def local_repositories(parent: str | None = None, paths: list[str] | None = None) -> list[Repository]:
    """The parent itself if it is a repository, else its children that are; and each of paths, which must be one."""
    roots: list[str] = []
    if parent:
        top = _ask(parent, "rev-parse", "--show-toplevel")
        children = [str(p) for p in sorted(Path(parent).iterdir()) if p.is_dir()] if not top else []
        roots += [top] if top else [t for c in children if (t := _ask(c, "rev-parse", "--show-toplevel")) and Path(t) == Path(c).resolve()]
    for path in paths or []:
        top = _ask(path, "rev-parse", "--show-toplevel")
        if not top:
            raise RepositoryError(f"{path} is no git repository")
        roots.append(top)
    return [_local(r) for r in dict.fromkeys(roots)]


def _local(root: str) -> Repository:
    url = _ask(root, "config", "--get", "remote.origin.url")
    try:
        name = github_name(url or "")
    except ValueError:
        name = Path(root).name
    return Repository(name, url, root, "git_repository", _ask(root, "rev-parse", "HEAD"))


def cloned(spec: str, folder: str, ref: str | None = None, depth: int | None = 1, timeout: int = 300) -> Repository:
    """A clone of a GitHub repository in folder, at ref; a ref that looks like a commit is checked out after cloning."""
    name = github_name(spec)
    url, root = f"https://github.com/{name}.git", str(Path(folder) / name.replace("/", "__"))
    commit = bool(ref and re.fullmatch("[0-9a-fA-F]{7,40}", ref))
    how = ["--branch", ref] if ref and not commit else []
    git("clone", "--quiet", *how, *(["--depth", str(depth)] if depth else []), url, root, timeout=timeout)
    if commit:
        git("fetch", "--quiet", "origin", ref, cwd=root, timeout=timeout)
        git("checkout", "--quiet", ref, cwd=root, timeout=timeout)
    return Repository(name, url, root, "github", _ask(root, "rev-parse", "HEAD"))


def remove_clones(spark: SparkSession) -> None:
    """Delete the clones of this application, when what was read from them has been stored."""
    for folder in _CLONES.pop(spark.sparkContext.applicationId, []):
        shutil.rmtree(folder, ignore_errors=True)


def creation_year(root: str, path: str) -> int | None:
    """The year of a file's first commit; null if it has none."""
    dates = _ask(root, "log", "--diff-filter=A", "--follow", "--format=%as", "--", path)
    return int(dates.splitlines()[-1][:4]) if dates else None


def code_files(
    spark: SparkSession,
    parent: str | None = None,
    paths: list[str] | None = None,
    repositories: list[str] | None = None,
    *,
    extensions: list[str] | None = sorted(LANGUAGES),
    file_names: list[str] | None = None,
    pattern: str | None = None,
    exclude: list[str] | None = None,
    max_bytes: int = 1_000_000,
    encoding: str = "utf-8",
    ref: str | None = None,
    depth: int | None = 1,
) -> DataFrame:
    """A row with COLUMNS for each file of the repositories that is wanted, by default without DEFAULT_EXCLUDES; contents are read only for those.

    pattern is a glob for paths within a repository. Clones are made in the
    folder that driver and executors share, where remove_clones finds them.
    """
    folder = f"{shared_folder(spark)}/clones-{uuid.uuid4().hex}" if repositories else ""
    exclude = DEFAULT_EXCLUDES if exclude is None else exclude
    if folder:
        Path(folder).mkdir(parents=True)
        _CLONES.setdefault(spark.sparkContext.applicationId, []).append(folder)
    roots = local_repositories(parent, paths) + [cloned(r, folder, ref, depth) for r in repositories or []]
    if not roots:
        raise RepositoryError("there is no repository")
    names = list(LANGUAGES_BY_NAME) if file_names is None else file_names
    out = None
    for r in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(r.root)
        path = F.regexp_replace("path", "^file:/*", "/")
        files = files.withColumn("source_path", path).withColumn("relative_path", F.substring("source_path", len(r.root.rstrip("/")) + 2, 1 << 30))
        name = base_name(F.col("relative_path"))
        wanted = name.isin(names) if names else F.lit(False)
        wanted = wanted | (suffix(name).isin([e.lower() for e in extensions]) if extensions is not None else F.lit(True))
        kept = files.where((F.col("length") <= max_bytes) & wanted & ~F.col("relative_path").startswith(".git/") & ~matches_any_glob(F.col("relative_path"), exclude))
        if pattern is not None:
            kept = kept.where(F.col("relative_path").rlike(glob_to_regex(pattern)))
        one = kept.select(
            F.lit(r.repo_id).alias("repo_id"), F.lit(r.repo_url).cast("string").alias("repo_url"), F.lit(r.commit_sha).cast("string").alias("commit_sha"), F.lit(r.source_kind).alias("source_kind"),
            F.lit(r.root).alias("repository_path"), "source_path", "relative_path", name.alias("file_name"), suffix(name).alias("file_extension"), code_language(F.col("relative_path")).alias("code_lang"),
            F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("content_sha256"), _decoded(F.col("content"), encoding).alias("content"),
        ).where("content is not null")
        out = one if out is None else out.unionByName(one)
    return out


def _decoded(content, encoding: str):
    if encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        valid = F.is_valid_utf8(content)
        return F.when(valid, F.decode(F.when(valid, content), "UTF-8"))

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        def one(x):
            try:
                return bytes(x).decode(encoding)
            except UnicodeDecodeError:
                return None

        return values.map(one)

    return decode(content)
