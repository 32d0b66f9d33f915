"""Extension points by name: built-in short names, or module.attribute of one's own."""

from __future__ import annotations

import importlib
from collections.abc import Callable


def load(path: str) -> Callable:
    """The callable that module.attribute (or module:attribute) names; ValueError if there is none."""
    module, _, name = path.replace(":", ".").rpartition(".")
    try:
        found = getattr(importlib.import_module(module), name)
    except (ImportError, AttributeError, ValueError) as e:
        raise ValueError(f"nothing to load at {path}") from e
    if not callable(found):
        raise ValueError(f"{path} is not callable")
    return found
