"""Registered queries, each next to the SQL that checks it."""

from importlib import import_module

_MODULES = ("basics", "joining", "profiling", "time_axis", "shapes", "models", "studies")


def load():
    """All queries and their SQL, by name."""
    from shelfcast.plans import registry

    for name in _MODULES:
        import_module(f"shelfcast.plans.{name}")
    return registry.QUERIES, registry.SQL
