"""Registered queries over the test tables, each with its SQL statement."""

from importlib import import_module

MODULES = (
    "interval_queries",
    "join_queries",
    "vote_queries",
    "segment_queries",
    "event_queries",
    "scalar_queries",
    "source_queries",
    "feature_queries",
    "stream_queries",
    "plan_queries",
    "refine_queries",
)


def load() -> None:
    """Import every catalog module so that its queries register."""
    for name in MODULES:
        import_module(f"spanline.catalog.{name}")
