"""Names, callables and oracle SQL of the queries over the driver's tables."""

from __future__ import annotations

from importlib import import_module

from tideline.session import ship

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its oracle SQL if there is one."""

    def put(f):
        def run(spark, sf_dir):
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        import_module(f"tideline.plans.{name}")


MODULES = ("windows", "store", "analytics", "combat", "fights", "accessors", "mining", "arenas")

load()
