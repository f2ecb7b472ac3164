"""Settings with their environment variables, read strictly."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields

from strandline.errors import EngineError


def env_int(name: str, default: int, least: int = 0) -> int:
    """An integer of at least ``least``; anything else is an error, not a default."""
    raw = os.environ.get(name, "")
    if raw == "":
        return default
    if not raw.strip().lstrip("-").isdigit() or int(raw) < least:
        raise EngineError("INVALID_ARGUMENT", f"{name} must be an integer of at least {least}")
    return int(raw)


def env_bool(name: str, default: bool) -> bool:
    raw = os.environ.get(name, "").strip().lower()
    if raw == "":
        return default
    if raw in ("1", "true", "yes", "on"):
        return True
    if raw in ("0", "false", "no", "off"):
        return False
    raise EngineError("INVALID_ARGUMENT", f"{name} must be true or false")


@dataclass(frozen=True)
class Config:
    #: Jobs of a resource class that may run at once.
    concurrency: dict[str, int] = field(default_factory=lambda: {"asr": 1, "vision": 2, "ocr": 2, "download": 2, "light": 4})
    max_frames: int = 500
    max_duration_sec: float = 14_400.0
    max_redirects: int = 5
    inline_seconds: float = 8.0
    heartbeat_ms: int = 5_000
    stale_after_ms: int = 30_000
    offline: bool = False
    max_download_mb: int = 2_048
    allow_private: bool = False
    #: Whether events carry the memory that the process holds.
    debug_memory: bool = False

    @classmethod
    def from_env(cls, prefix: str = "STRANDLINE_") -> Config:
        made = {}
        for f in fields(cls):
            if f.name in ("concurrency",):
                continue
            kind, name = type(f.default), prefix + f.name.upper()
            made[f.name] = env_bool(name, f.default) if kind is bool else kind(env_int(name, int(f.default)))
        return cls(**made)
