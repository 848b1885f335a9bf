"""Settings from a .env file and the environment, which wins."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    data_dir: str = "./data/runtime"
    upload_dir: str = "./data/uploads"
    embedding_backend: str = "auto"  # auto, tfidf, hash or encoder
    embedding_model: str = ""  # for an encoder of your own
    enable_llm_extraction: bool = False
    merge_threshold: float = 0.82

    @classmethod
    def load(cls, environ: Mapping[str, str] | None = None, env_file: str | None = ".env") -> Settings:
        """Settings by upper or lower case names; unknown names and lines that are no assignment are left alone."""
        given: dict[str, str] = {}
        if env_file and os.path.exists(env_file):
            with open(env_file, encoding="utf-8") as f:
                pairs = (line.split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#"))
                given = {k.strip().lower(): v.strip().strip("\"'") for k, v in pairs}
        given |= {k.lower(): v for k, v in (os.environ if environ is None else environ).items()}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        read = {bool: lambda v: v.strip().lower() in ("1", "true", "yes", "on"), float: float, str: str}
        return cls(**{k: read[kind](given[k]) for k, kind in kinds.items() if k in given})
