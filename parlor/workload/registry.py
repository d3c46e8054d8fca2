"""All registered queries and their SQL twins, module by module."""

from __future__ import annotations

import importlib

MODULES = ("messaging", "contacts", "grants", "notify", "pages", "files", "changes", "streams")


def _collect(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        part = getattr(importlib.import_module(f"parlor.workload.{name}"), attribute)
        clash = found.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        found.update(part)
    return found


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict[str, str]:
    return _collect("ORACLES")
