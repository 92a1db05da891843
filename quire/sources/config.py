"""Run settings: command line over file over default."""

from __future__ import annotations

import dataclasses
import tomllib
from pathlib import Path
from typing import Any


@dataclasses.dataclass(frozen=True)
class RunConfig:
    output_mode: str = "obsidian"
    download_images: bool = False
    output_dir: str | None = None
    auto_threshold: int = 10
    review_threshold: int = 3
    max_keywords: int = 20
    max_chapters: int = 5000

    def __post_init__(self) -> None:
        if self.output_mode not in ("obsidian", "translate", "raw"):
            raise ValueError(f"unknown output mode {self.output_mode!r}")


def load(path: str | None = None, **given: Any) -> RunConfig:
    """Settings from a TOML file's [run] table, overridden by the given ones that are not None."""
    told = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("run", {}) if path and Path(path).exists() else {}
    names = {f.name for f in dataclasses.fields(RunConfig)}
    merged = {k: v for k, v in told.items() if k in names} | {k: v for k, v in given.items() if v is not None}
    return RunConfig(**merged)
