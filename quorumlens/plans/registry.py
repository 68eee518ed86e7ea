"""Registry of queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, with_ctes

QueryFn = Callable[[Tables], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    body: str | None
    uses: str

    @property
    def sql(self) -> str | None:
        return with_ctes(self.uses, self.body) if self.body else None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, uses: str = "") -> Callable[[QueryFn], QueryFn]:
    """Register a query.  `uses` names the shared SQL tables that `sql` reads, separated by spaces."""

    def register(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Entry(run, sql, uses)
        return fn

    return register
