"""Settings as JSON, with a sample that is written where none exists."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass


# The sample's address of a model server, models and context sizes.
MODEL_URL = "http://localhost:11434"
EMBED_MODEL, TEXT_MODEL = "nomic-embed-text", "llama3.2"
EMBED_CONTEXT, TEXT_CONTEXT = 8192, 128_000


@dataclass
class Model:
    url: list[str] = field(default_factory=lambda: [MODEL_URL])
    model: str = ""
    num_ctx: int = EMBED_CONTEXT


@dataclass
class Models:
    embed: Model = field(default_factory=lambda: Model(model=EMBED_MODEL))
    generate: Model = field(default_factory=lambda: Model(model=TEXT_MODEL, num_ctx=TEXT_CONTEXT))
    chat: Model = field(default_factory=lambda: Model(model=TEXT_MODEL, num_ctx=TEXT_CONTEXT))


@dataclass
class Storage:
    documents: str = "./store/documents"
    embeddings: str = "./store/embeddings"
    centroids: str = "./store/centroids"


@dataclass
class Settings:
    ai: Models = field(default_factory=Models)
    storage: Storage = field(default_factory=Storage)
    owner: str = "wikipedia"
    category: str = "wikipedia"
    log_level: str = "info"

    @property
    def upload_parallelism(self) -> int:
        """Ten uploads at a time for each embedding address."""
        return 10 * len(self.ai.embed.url)


def _filled(kind, values: dict):
    if not isinstance(values, dict):
        raise ValueError(f"{kind.__name__} must be an object")
    known = {f.name.lower(): f for f in fields(kind)}
    out = kind()
    for key, value in values.items():
        if f := known.get(key.lower()):
            now = getattr(out, f.name)
            setattr(out, f.name, _filled(type(now), value) if is_dataclass(now) else value)
    return out


def parse_settings(raw: str | bytes) -> Settings:
    """Keys match in any case, unknown ones are ignored, missing ones keep their defaults."""
    return _filled(Settings, json.loads(raw))


def load_settings(path: str) -> Settings:
    """Settings of a file; where it is missing, the sample is written, readable by its owner alone."""
    if not os.path.exists(path):
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600), "w") as f:
            json.dump(asdict(Settings()), f, indent=4)
    with open(path) as f:
        return parse_settings(f.read())
