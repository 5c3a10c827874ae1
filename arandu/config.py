"""Settings from the environment and a .env file, which never replaces what the environment has."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

PREFIX = "ARANDU_"


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    ocr_provider: str = "auto"
    ocr_language_hint: str = "pt,en"
    vision_endpoint: str | None = None
    vision_key: str | None = None
    tesseract_cmd: str | None = None
    model_endpoint: str | None = None
    model_key: str | None = None
    model_name: str | None = None

    def missing_for_answers(self) -> list[str]:
        return [PREFIX + n.upper() for n in ("model_endpoint", "model_key", "model_name") if not getattr(self, n)]


def read_env(text: str) -> dict[str, str]:
    """NAME=value lines; quotes around a value go, comments and lines without = are left out."""
    out: dict[str, str] = {}
    for line in map(str.strip, text.splitlines()):
        name, joint, value = line.partition("=")
        name, value = name.strip(), value.strip()
        if joint and name and not line.startswith("#"):
            out[name] = value[1:-1] if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'" else value
    return out


def settings(env: Mapping[str, str] | None = None, env_file: str | None = None) -> Settings:
    known = dict(os.environ if env is None else env)
    if env_file and Path(env_file).exists():
        known = read_env(Path(env_file).read_text(encoding="utf-8", errors="ignore")) | known
    own = {f: known[PREFIX + f.upper()].strip() for f in Settings.__dataclass_fields__ if known.get(PREFIX + f.upper(), "").strip()}
    return Settings(**own)
