"""Every runnable query with the statement that checks it."""

from __future__ import annotations

import importlib

_MODULES = ("factors", "analysis", "strategy", "research")


def _merged(kind: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        part = getattr(importlib.import_module(f".{name}", __name__), kind)()
        clash = set(out) & set(part)
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _merged("queries")


def oracle_sql() -> dict[str, str]:
    return _merged("oracle_sql")
