"""Settings of a run: defaults, then a file of ``NAME=value`` lines, then the environment.

Names begin with ``SPANWRIGHT_``; a name that is not a setting, or a value that does not fit, is an error.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

from .functions.rules import Limits

PREFIX = "SPANWRIGHT_"


class SettingsError(ValueError):
    """A setting that does not exist or does not fit."""


@dataclass(frozen=True)
class Settings:
    low_score: float = 0.5
    context_chars: int = 8192
    context_share: float = 0.9
    repeats: int = 5
    cost_factor: float = 3.0
    cluster_cut: float = 0.62
    max_clusters: int = 10
    baseline_days: int = 14
    window_days: int = 3
    alpha: float = 0.01
    cusum_h: float = 5.0

    def limits(self) -> Limits:
        """The thresholds of the rules."""
        return Limits(low_score=self.low_score, context_chars=self.context_chars, context_share=self.context_share, repeats=self.repeats, cost_factor=self.cost_factor)


def _lines(text: str) -> dict[str, str]:
    """NAME=value of each line; blank lines and those that begin with # are left out, quotes around a value go."""
    out = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        name, found, value = line.partition("=")
        if not found:
            raise SettingsError(f"line {number}: NAME=value is expected")
        out[name.removeprefix("export ").strip()] = value.strip().strip("'\"")
    return out


def load(environment: Mapping[str, str] | None = None, file: str | None = None) -> Settings:
    """The settings; ``environment``: that of the process unless given."""
    given: dict[str, str] = {}
    if file is not None:
        with open(file, encoding="utf-8") as f:
            given |= _lines(f.read())
    given |= dict(os.environ if environment is None else environment)
    known = {f.name: f.type for f in fields(Settings)}
    out = Settings()
    for name, value in given.items():
        if not name.startswith(PREFIX):
            continue
        key = name.removeprefix(PREFIX).lower()
        if key not in known:
            raise SettingsError(f"{name} is not a setting")
        try:
            out = replace(out, **{key: (int if known[key] == "int" else float)(value)})
        except ValueError:
            raise SettingsError(f"{name} is not a number: {value}") from None
    return out
