"""Settings in three tiers: a folder's config.toml, the one in the home folder, and defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from loomframe.errors import LoomError


@dataclass(frozen=True)
class Config:
    org: str = ""
    seed: int = 42
    log_level: str = "info"
    as_type: str | None = None
    formula_folder: str | None = None


_LEVELS = ("error", "warn", "info", "debug")


def parse(text: str) -> dict:
    """The settings of one TOML text; unknown names and wrong types are errors."""
    table = tomllib.loads(text)
    kinds = {"org": str, "seed": int, "log_level": str, "as_type": str, "formula_folder": str}
    for k, v in table.items():
        if k not in kinds:
            raise LoomError(f"no setting '{k}'", f"There are: {', '.join(kinds)}")
        if not isinstance(v, kinds[k]) or isinstance(v, bool):
            raise LoomError(f"setting '{k}' must be of type {kinds[k].__name__}")
    if table.get("log_level", "info") not in _LEVELS:
        raise LoomError(f"no log level '{table['log_level']}'", f"There are: {', '.join(_LEVELS)}")
    return table


def load(folder: str | Path | None = None, home: str | Path | None = None) -> Config:
    config = Config()
    for path in (Path(home) / "config.toml" if home else Path.home() / ".loomframe" / "config.toml", Path(folder) / "config.toml" if folder else None):
        if path and path.is_file():
            config = replace(config, **parse(path.read_text(encoding="utf-8")))
    return config


NAMES = [f.name for f in fields(Config)]
