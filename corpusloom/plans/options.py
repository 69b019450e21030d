"""Options of a run, and the JSON files that set their defaults."""

from __future__ import annotations

import json
import os
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    aggressive: bool = False
    compact: bool = False
    no_frame: bool = False
    stats: bool = False
    force_type: str | None = None
    force_diff: bool = False
    focus: str | None = None
    prompt: str | None = None
    brand: str = "stats"

    @property
    def effective_aggressive(self) -> bool:
        return self.aggressive or self.compact

    def merged(self, defaults: Options) -> Options:
        """Switches that are on in either."""
        on = {k: getattr(self, k) or getattr(defaults, k) for k in ("aggressive", "compact", "no_frame", "stats")}
        return replace(self, **on)


def default_files() -> list[str]:
    return [".corpusloom.json", os.path.expanduser("~/.config/corpusloom/config.json")]


def load(files: Iterable[str] | None = None) -> Options:
    """Defaults from the first valid file; files are not layered, and a broken one is passed over with a warning."""
    for path in default_files() if files is None else files:
        if not os.path.exists(path):
            continue
        try:
            with open(path, encoding="utf-8") as f:
                found = json.load(f).get("defaults", {})
            known = {x.name for x in fields(Options)} & {"aggressive", "compact", "no_frame", "stats"}
            if not all(isinstance(found.get(k, False), bool) for k in known):
                raise ValueError("defaults are true or false")
            return Options(**{k: found.get(k, False) for k in known})
        except (ValueError, AttributeError, OSError) as e:
            warnings.warn(f"{path} is not used: {e}", stacklevel=2)
    return Options()
