"""Run configurations: defaults, then a file, then overrides; unknown fields are errors."""

from __future__ import annotations

import hashlib
import os
import re
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

from loomspark.schemas import QUERY_TYPES, REASONING_TYPES

# Names of settings that hold credentials, and endings of such names; names that end in _env tell a variable and are shown.
SECRET_NAMES = ("access_token", "api_key", "apikey", "authorization", "password", "proxy_authorization", "refresh_token", "secret", "token")
SECRET_ENDINGS = ("_access_token", "_api_key", "_password", "_refresh_token", "_secret")
# Provider body fields that are shown, with their types.
_SHOWN_BODY = {"input_type": str, "truncate": str}
REDACTED = "<redacted>"


def is_secret(name: str) -> bool:
    """Whether a setting of this name holds a credential."""
    name = name.lower().replace("-", "_")
    return not name.endswith("_env") and (name in SECRET_NAMES or name.endswith(SECRET_ENDINGS))


def redacted(value: Any) -> Any:
    """A copy without credentials: secret keys, all header values, and unknown provider body fields."""
    if isinstance(value, list):
        return [redacted(v) for v in value]
    if not isinstance(value, dict):
        return value
    out = {}
    for key, v in value.items():
        if v is None:
            out[key] = None
        elif key == "extra_headers":
            out[key] = dict.fromkeys(v, REDACTED) if isinstance(v, dict) else REDACTED
        elif key == "extra_body":
            out[key] = {k: x if k in _SHOWN_BODY and isinstance(x, _SHOWN_BODY[k]) else REDACTED for k, x in v.items()} if isinstance(v, dict) else REDACTED
        else:
            out[key] = REDACTED if is_secret(str(key)) else redacted(v)
    return out


def _counts(name: str, counts: dict[str, int], keys: tuple[str, ...], total: int) -> None:
    if set(counts) != set(keys):
        raise ValueError(f"{name} needs exactly the keys {', '.join(keys)}")
    if any(n < 0 for n in counts.values()) or sum(counts.values()) != total:
        raise ValueError(f"{name} must add up to num_pairs, {total}")


@dataclass(frozen=True)
class PipelineConfig:
    max_artifacts_per_type: int = 2
    num_pairs: int = 7
    query_counts: dict[str, int] = field(default_factory=lambda: {"multi_hop": 3, "structural": 2, "contextual": 2})
    min_hops: int = 1
    max_hops: int = 3
    reasoning_counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(REASONING_TYPES, 1))
    min_complexity: int = 2
    similarity_threshold: float = 0.9
    max_parallel_requests: int | None = None
    models: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if min(self.max_artifacts_per_type, self.num_pairs, self.min_hops) < 1 or not 1 <= self.min_complexity <= 5:
            raise ValueError("a bound is out of range")
        if self.min_hops > self.max_hops:
            raise ValueError("min_hops is more than max_hops")
        if not 0 <= self.similarity_threshold <= 1:
            raise ValueError("similarity_threshold is not between 0 and 1")
        _counts("query_counts", self.query_counts, QUERY_TYPES, self.num_pairs)
        _counts("reasoning_counts", self.reasoning_counts, REASONING_TYPES, self.num_pairs)


@dataclass(frozen=True)
class SeedConfig:
    path: str = "."
    file_extensions: tuple[str, ...] | None = (".txt", ".md", ".text")
    min_text_length: int = 50
    sentences_per_chunk: int = 5
    num_sections: int = 1
    num_files: int | None = None
    multi_doc: bool = False
    bundle_size: int = 2
    bundle_strategy: str = "sequential"
    max_docs_per_bundle: int = 3
    manifest: str | None = None

    def __post_init__(self):
        if self.sentences_per_chunk < 1 or self.num_sections < 1 or self.bundle_size < 1 or (self.num_files or 1) < 1:
            raise ValueError("a seed setting is out of range")
        if self.bundle_size > self.max_docs_per_bundle:
            raise ValueError("bundle_size is more than max_docs_per_bundle")


@dataclass(frozen=True)
class RepositoryConfig:
    """What to read of git repositories."""

    path: str | None = None
    repository_paths: tuple[str, ...] = ()
    repositories: tuple[str, ...] = ()
    ref: str | None = None
    include_extensions: tuple[str, ...] | None = None
    include_file_names: tuple[str, ...] | None = None
    exclude_patterns: tuple[str, ...] | None = None
    max_file_size_bytes: int = 1_000_000
    encoding: str = "utf-8"
    clone_depth: int | None = 1
    clone_timeout_seconds: int = 300

    def __post_init__(self):
        if not (self.path or self.repository_paths or self.repositories):
            raise ValueError("a path or a repository is needed")
        if self.max_file_size_bytes < 1 or self.clone_timeout_seconds < 1 or (self.clone_depth is not None and self.clone_depth < 1):
            raise ValueError("a repository setting is out of range")
        "".encode(self.encoding)


@dataclass(frozen=True)
class GenerationConfig:
    seed_source: SeedConfig = field(default_factory=SeedConfig)
    output_dir: str = "./generated"
    dataset_name: str | None = None
    buffer_size: int = 200
    resume: str = "never"
    pipeline: PipelineConfig = field(default_factory=PipelineConfig)
    num_records: int | None = None
    start_index: int = 0
    end_index: int | None = None

    def __post_init__(self):
        if self.start_index < 0 or (self.end_index is not None and self.end_index < self.start_index):
            raise ValueError("start_index and end_index are no range")
        if self.buffer_size < 1 or self.resume not in ("never", "always", "if_possible"):
            raise ValueError("buffer_size or resume is out of range")
        if self.dataset_name is not None and (self.dataset_name in ("", ".", "..") or re.search(r"[/\\\x00-\x1f\x7f]", self.dataset_name)):
            raise ValueError("dataset_name must be one path step")


@dataclass(frozen=True)
class ConversionConfig:
    input_path: str = "./generated/retrieval_sdg.jsonl"
    corpus_id: str = "retrieval_sdg"
    output_dir: str | None = None
    eval_only: bool = False
    train_ratio: float = 0.8
    val_ratio: float = 0.1
    seed: int = 42
    quality_threshold: float = 7.0
    max_pos_docs: int = 5
    use_group_id_in_eval: bool = False
    split_strategy: str = "random"
    groups_json: tuple[str, ...] | None = None

    def __post_init__(self):
        if min(self.train_ratio, self.val_ratio) < 0 or self.train_ratio + self.val_ratio > 1:
            raise ValueError("train_ratio and val_ratio must be between 0 and 1 together")
        if self.split_strategy not in ("random", "dedupped", "cluster"):
            raise ValueError("unknown split_strategy")
        if self.max_pos_docs < 1 or not self.corpus_id:
            raise ValueError("a conversion setting is out of range")

    def folder(self) -> Path:
        """The output folder: as given, else beside the input."""
        base = Path(self.input_path)
        return Path(self.output_dir) if self.output_dir else base.with_name(f"{base.stem}_{'eval' if self.eval_only else 'train_eval'}")


def merged(low: dict, high: dict) -> dict:
    """low with high's leaves put in."""
    return low | {k: merged(low[k], v) if isinstance(v, dict) and isinstance(low.get(k), dict) else v for k, v in high.items()}


def leaves(values: dict, prefix: str = "") -> list[str]:
    return [p for k, v in values.items() for p in (leaves(v, f"{prefix}{k}.") if isinstance(v, dict) and v else [f"{prefix}{k}"])]


def from_mapping(kind: type, values: dict) -> Any:
    """A configuration; unknown fields are errors, lists become tuples."""
    known = {f.name: f for f in fields(kind)}
    if extra := set(values) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(extra))}")
    nested = {"seed_source": SeedConfig, "pipeline": PipelineConfig}
    return kind(**{k: from_mapping(nested[k], v) if k in nested and isinstance(v, dict) else tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def load(kind: type, path: str | None = None, *overrides: dict) -> tuple[Any, dict]:
    """A configuration and where it is from: the file with its hash, and the settings each later layer overrode."""
    values, origin = {}, {"file": None, "sha256": None, "overrides": []}
    if path:
        import yaml

        raw = Path(path).read_bytes()
        values = yaml.safe_load(raw) or {}
        if not isinstance(values, dict):
            raise ValueError(f"{path} has no settings")
        origin |= {"file": path, "sha256": hashlib.sha256(raw).hexdigest()}
    for layer in overrides:
        values = merged(values, layer)
        origin["overrides"] += leaves(layer)
    return from_mapping(kind, values), origin


def environment_value(text: str) -> str:
    """What ${NAME} stands for; other texts as they are."""
    m = re.fullmatch(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", text)
    if not m:
        return text
    if m[1] not in os.environ:
        raise ValueError(f"{m[1]} is not set")
    return os.environ[m[1]]


def with_environment(values: Any) -> tuple[Any, list[str]]:
    """A copy of values with what each exact ${NAME} stands for, and the names used; provenance keeps those."""
    if isinstance(values, dict):
        pairs = {k: with_environment(v) for k, v in values.items()}
        return {k: v for k, (v, _) in pairs.items()}, sorted({n for _, names in pairs.values() for n in names})
    if isinstance(values, list):
        found = [with_environment(v) for v in values]
        return [v for v, _ in found], sorted({n for _, names in found for n in names})
    if isinstance(values, str) and (new := environment_value(values)) != values:
        return new, [values[2:-1]]
    return values, []


def producer_version() -> str:
    """The installed package's version; 0+unknown where it is run from its sources."""
    from importlib.metadata import PackageNotFoundError, version

    try:
        return version("loomspark")
    except PackageNotFoundError:
        return "0+unknown"


def is_under(path: str, root: str) -> bool:
    """Whether a path, links followed, is within root."""
    return Path(path).resolve().is_relative_to(Path(root).resolve())


def as_mapping(config: Any) -> dict:
    return asdict(config)
