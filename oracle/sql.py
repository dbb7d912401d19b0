"""All SQL texts, composed with the views they use."""

from __future__ import annotations

from importlib import import_module

from .views import compose

_MODULES = ("s_sources", "s_scalars", "s_prose", "s_layout", "s_geometry", "s_catalogue",
            "s_pages", "s_sequences", "s_lookups", "s_editlog", "s_composites")


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _MODULES:
        for name, text in import_module(f"{__package__}.{m}").SQL.items():
            out[name] = compose(text)
    return out
