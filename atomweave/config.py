"""Settings of the engine, from a JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass

from .sources import elements as el

#: The names of the settings in the file.
NAMES = {"EXCLUDED_ELEMENTS": "excluded", "NEIGHBOR_SEARCH_SCALE": "search", "BOND_DISTANCE_SCALE": "bond"}


@dataclass(frozen=True)
class EngineConfig:
    """Elements that never bond, and the scales of the search radius and of the longest bond."""

    excluded: tuple[str, ...] = tuple(el.EXCLUDED)
    search: float = el.SEARCH_SCALE
    bond: float = el.BOND_SCALE

    def __post_init__(self):
        if self.search <= 0 or self.bond <= 0:
            raise ValueError("scales are positive")

    @classmethod
    def load(cls, path: str | None = None) -> EngineConfig:
        """From a JSON object with some of the names; the others keep their defaults, unknown names are an error."""
        if path is None:
            return cls()
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        unknown = set(given) - set(NAMES)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        values = {NAMES[k]: v for k, v in given.items()}
        if "excluded" in values:
            values["excluded"] = tuple(values["excluded"])
        return cls(**values)
