"""Registered queries: every operator over the whole test tables, with its SQL counterpart."""

from __future__ import annotations

from capturelake.catalog import clouds, datasets, files, frames, photos, streams

MODULES = (frames, photos, clouds, datasets, files, streams)


def registered() -> dict[str, tuple]:
    """name -> (query, SQL or None)."""
    out: dict[str, tuple] = {}
    for module in MODULES:
        clash = out.keys() & module.QUERIES.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(module.QUERIES)
    return out
