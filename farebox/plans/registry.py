"""How a module of queries registers them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Registry:
    """Queries by name, and the SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def r6(c: Column | str, name: str) -> Column:
    return F.round(c, 6).alias(name)
