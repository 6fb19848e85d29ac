"""Driver queries."""

from importlib import import_module

MODULES = (
    "text_queries",
    "classify_queries",
    "dedupe_queries",
    "corpus_queries",
    "ops_queries",
    "period_queries",
    "validate_queries",
    "profile_queries",
    "stream_queries",
)


def load() -> tuple[dict, dict]:
    """(queries, oracle SQL) of every plan module."""
    for name in MODULES:
        import_module(f"engram.plans.{name}")
    registry = import_module("engram.plans.registry")
    return registry.QUERIES, registry.ORACLES
