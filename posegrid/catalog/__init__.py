"""The registered queries and their SQL twins over the test tables."""

from __future__ import annotations

import importlib

MODULES = ("points", "frames", "surfaces", "pipelines", "known")


def load():
    from . import registry

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return registry.QUERIES, registry.ORACLES
