"""Named queries over the supplied tables, grouped by subject."""

from __future__ import annotations

import importlib
import pkgutil


def load_all() -> None:
    """Import every catalog module, which fills the registry."""
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
