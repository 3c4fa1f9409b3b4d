"""The checked queries by area."""

import importlib

AREAS = (
    "text", "requests", "quality", "policy", "evaluation", "monitoring", "registry", "terms", "streaming",
    "tables", "model",
)


def load_all():
    """All queries and their SQL twins."""
    from catalog import _base

    for area in AREAS:
        importlib.import_module(f"catalog.{area}")
    return _base.QUERIES, _base.ORACLES
