"""Registered queries and their reference SQL, merged from the modules of this folder."""

from __future__ import annotations

from importlib import import_module

_MODULES = [
    "scans", "writes", "filters", "joins", "aggregates", "series", "selection", "layers", "quality", "governance",
    "streams",
]


def merged(attribute: str) -> dict:
    out: dict = {}
    for name in _MODULES:
        part = getattr(import_module(f"{__name__}.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out
