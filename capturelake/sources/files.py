"""File systems as pyarrow opens them."""

from __future__ import annotations

from pyarrow import fs as pafs


def open_root(root: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a local path or a URI."""
    if root.startswith("file:/") and not root.startswith("file://"):
        root = root[len("file:"):]
    return pafs.FileSystem.from_uri(root)
