"""Model roles and providers: which model answers what, and where it is reached."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

CHAT, EMBEDDING = "chat-completion", "embedding"
# The roles that answer prompts, and the parameters of their calls and of embeddings.
CHAT_ROLES = ("artifact_extraction", "qa_generation", "quality_judge")
CHAT_PARAMETERS = {"temperature": 0.6, "top_p": 0.95, "timeout": 120}
EMBEDDING_PARAMETERS = {"max_parallel_requests": 8, "extra_body": {"input_type": "query", "truncate": "NONE"}}


@dataclass(frozen=True)
class Model:
    alias: str
    model: str
    provider: str
    kind: str = CHAT
    parameters: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Provider:
    """An endpoint; api_key is a key or the name of an environment variable."""

    name: str
    endpoint: str
    provider_type: str = "openai"
    api_key: str | None = None

    def checked(self) -> Provider:
        if not self.name or not self.endpoint:
            raise ValueError("a provider needs a name and an endpoint")
        return self


def model_suite(chat: dict[str, tuple[str, str]], embed: tuple[str, str], max_parallel: int | None = None) -> tuple[list[Model], dict[str, str]]:
    """Models and the alias that each role uses, of (model, provider) by role.

    Roles of one model and provider share the alias of the first of them; the
    embedding model has its own.
    """
    if set(chat) != set(CHAT_ROLES):
        raise ValueError(f"models are needed for {', '.join(CHAT_ROLES)}")
    limit = {} if max_parallel is None else {"max_parallel_requests": max_parallel}
    models = {("embed",): Model("embed", *embed, EMBEDDING, dict(EMBEDDING_PARAMETERS))}
    aliases = {"embed": "embed"}
    for role in CHAT_ROLES:
        own = models.setdefault(chat[role], Model(role, *chat[role], CHAT, CHAT_PARAMETERS | limit))
        aliases[role] = own.alias
    return list(models.values()), aliases


def check_embedding(alias: str, models: Iterable[Model]) -> Model:
    """The model of an alias, which must be an embedding model."""
    found = {m.alias: m for m in models}.get(alias)
    if found is None:
        raise ValueError(f"there is no model {alias}")
    if found.kind != EMBEDDING:
        raise ValueError(f"{alias} is a {found.kind} model; embeddings need one of kind {EMBEDDING}")
    return found


def _named(providers: Iterable[Provider], source: str) -> dict[str, Provider]:
    out: dict[str, Provider] = {}
    for p in providers:
        if out.setdefault(p.name, p.checked()) != p:
            raise ValueError(f"{source} has different providers named {p.name}")
    return out


def read_providers(path: str) -> list[Provider]:
    """Providers of a YAML or JSON file, which holds a list of them."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        entries = yaml.safe_load(raw)
    else:
        entries = json.loads(raw)
    if not isinstance(entries, list):
        raise ValueError(f"{path} must hold a list of providers")
    return [Provider(**e) for e in entries]


def providers(
    configured: Iterable[Provider] = (), file: str | None = None, inline: dict | None = None, defaults: Callable[[], Iterable[Provider]] = tuple
) -> tuple[list[Provider] | None, list[Provider]]:
    """All providers and the custom ones among them; None and none if there are no custom ones.

    A provider of the file replaces a configured one of its name, and an inline
    one replaces either, but for the fields it doesn't give. Two different ones
    of a name in one place are an error. Defaults stay unless a custom one has
    their name.
    """
    custom = _named(configured, "the configuration")
    if file is not None:
        custom |= _named(read_providers(file), file)
    if inline is not None and inline.get("endpoint") is not None or inline and inline.get("name", "custom") in custom:
        name = inline.get("name", "custom")
        custom[name] = (replace(custom[name], **inline) if name in custom else Provider(**{"name": name, **inline})).checked()
    if not custom:
        return None, []
    return [p for p in defaults() if p.name not in custom] + list(custom.values()), list(custom.values())


def described(models: Iterable[Model], custom: Iterable[Provider] = ()) -> list[str]:
    """Lines that tell the models and providers of a run; of keys only whether there is one."""
    lines = [f"{m.alias}: {m.model} at {m.provider}" for m in models]
    return lines + [f"provider {p.name}: {p.endpoint} ({p.provider_type}, {'with' if p.api_key else 'without'} a key)" for p in custom]


def as_mappings(models: Iterable[Model]) -> list[dict]:
    return [asdict(m) for m in models]
