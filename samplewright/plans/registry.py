"""Names of operators and what stands behind them."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Entry:
    """A relation-to-relation function, its version, and the dataclass of its configuration."""

    name: str
    version: str
    function: Callable
    config: type | None = None


class Operators:
    """A second version under one name is refused; configurations are checked against the declared fields."""

    def __init__(self) -> None:
        self._entries: dict[str, Entry] = {}

    def register(self, name: str, version: str, function: Callable, config: type | None = None) -> None:
        known = self._entries.get(name)
        if known and known.version != version:
            raise ValueError(f"{name} is registered in version {known.version}")
        self._entries[name] = Entry(name, version, function, config)

    def get(self, name: str) -> Entry:
        if name not in self._entries:
            raise KeyError(f"operator {name} is not registered")
        return self._entries[name]

    def configure(self, name: str, values: dict) -> object:
        entry = self.get(name)
        if entry.config is None:
            if values:
                raise ValueError(f"{name} takes no configuration")
            return None
        unknown = set(values) - {f.name for f in dataclasses.fields(entry.config)}
        if unknown:
            raise ValueError(f"{name}: unknown fields {', '.join(sorted(unknown))}")
        return entry.config(**values)

    def names(self) -> list[str]:
        return sorted(self._entries)
