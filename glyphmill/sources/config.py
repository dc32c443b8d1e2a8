"""Per-project override files: id, name, toggles, budget and ignore patterns; unknown keys are errors."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ProjectFile:
    id: str | None = None
    name: str | None = None
    watch: bool = True
    index: bool = True
    budget: int | None = None
    ignore: tuple[str, ...] = field(default=())

    @staticmethod
    def parse(data: str) -> ProjectFile:
        values = tomllib.loads(data)
        if unknown := set(values) - set(ProjectFile.__dataclass_fields__):
            raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
        if "ignore" in values:
            values["ignore"] = tuple(values["ignore"])
        return ProjectFile(**values)


def root_key(path: str) -> str:
    """One spelling for a directory: forward slashes, no trailing one, no scheme."""
    path = path.replace("\\", "/").removeprefix("file://")
    return path.rstrip("/") or "/"
