"""Results kept while the data stay the same, and running queries by tag."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from graphloom.operators.compiler import Result, run
from graphloom.plans.lexer import tokens
from graphloom.sources.catalog import Catalog
from graphloom.sources.scratch import settled


def normal_form(query: str) -> tuple:
    """A query without its white space, that inside quotes excepted."""
    return tuple((t.kind, t.text) for t in tokens(query))


@dataclass
class QueryCache:
    """Results by query, grouping, position and snapshot of the data. With `written`, rows are computed once into the
    shared folder; else the plan is kept and each use computes it. Results of other snapshots go when one is asked for.
    """

    written: bool = True
    most: int = 256
    rows: dict[tuple, Result] = field(default_factory=dict)
    owners: dict[tuple, set[str]] = field(default_factory=dict)

    def run(self, catalog: Catalog, query: str, groupby: int | None = None, output: str | None = None, owner: str = "", **start) -> Result:
        key = (catalog.snapshot, normal_form(query), groupby, output, tuple(sorted(start.items())))

        def made() -> Result:
            got = run(catalog, query, groupby=groupby, output=output, **start)
            return replace(got, df=settled(got.df)) if self.written else got

        return self.get(key, made, owner)

    def get(self, key: tuple, make: Callable[[], Result], owner: str = "") -> Result:
        """What the key holds, made if it holds nothing. A key starts with its snapshot."""
        for old in [k for k in self.rows if k[0] != key[0]]:
            self.drop(old)
        if key not in self.rows:
            while len(self.rows) >= self.most:
                self.drop(next(iter(self.rows)))
            self.rows[key] = make()
        self.owners.setdefault(key, set()).add(owner)
        return self.rows[key]

    def drop(self, key: tuple) -> None:
        self.rows.pop(key, None)
        self.owners.pop(key, None)

    def leave(self, owner: str) -> None:
        """Drops what no other owner has asked for."""
        for key in [k for k, who in self.owners.items() if owner in who]:
            self.owners[key].discard(owner)
            if not self.owners[key]:
                self.drop(key)

    def flush(self) -> None:
        self.rows.clear()
        self.owners.clear()


@contextmanager
def tagged(spark: SparkSession, tag: str):
    """Runs queries under a tag, by which kill() ends them."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


def kill(spark: SparkSession, tag: str) -> list[str]:
    return spark.interruptTag(tag)
