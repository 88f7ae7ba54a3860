"""U1 operator_registry: ``name -> f(spark, sf_dir) -> DataFrame``.

Duplicate names are rejected (as the reference's template registry does).  Each
entry may carry the ANSI SQL its result must equal on DuckDB; entries without
SQL get a rows-only check plus pytest on hand-computed values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quarry.plans.view_sql import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    fn: QueryFn
    sql: str | None
    doc: str


class OperatorRegistry:
    def __init__(self) -> None:
        self._entries: dict[str, Entry] = {}

    def register(self, name: str, fn: QueryFn, sql: str | None = None, doc: str = "") -> None:
        if name in self._entries:
            raise ValueError(f"operator {name!r} is already registered")
        self._entries[name] = Entry(name, fn, with_views(sql) if sql else None, doc)

    def query(self, name: str, sql: str | None = None):
        """Decorator form of :meth:`register`."""

        def deco(fn: QueryFn) -> QueryFn:
            self.register(name, fn, sql, (fn.__doc__ or "").strip())
            return fn

        return deco

    def names(self) -> list[str]:
        return list(self._entries)

    def get(self, name: str) -> Entry:
        return self._entries[name]

    def run(self, name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.queries()[name](spark, sf_dir)

    def queries(self) -> dict[str, QueryFn]:
        """Callables that first apply the session settings the operators rely
        on (UTC, AQE, shared checkpoint folder), then build the query."""
        from quarry.session import configure_session

        def wrap(fn: QueryFn) -> QueryFn:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                configure_session(spark)
                return fn(spark, sf_dir)

            run.__name__, run.__doc__ = fn.__name__, fn.__doc__
            return run

        return {k: wrap(e.fn) for k, e in self._entries.items()}

    def oracles(self) -> dict[str, str]:
        return {k: e.sql for k, e in self._entries.items() if e.sql}


REGISTRY = OperatorRegistry()
query = REGISTRY.query
