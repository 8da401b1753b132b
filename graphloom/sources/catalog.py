"""Entity catalogs: what a query may name, and the tables and joins behind it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.lexer import QueryError


@dataclass(frozen=True)
class Selector:
    """Navigation to entities of the kind `result`.

    child: the result's table has the column `key` that holds this entity's id (each result has one parent).
    parent: this entity's table has the column `key` that holds the result's id.
    Otherwise pairs gives the (src, dst) rows.
    """

    names: tuple[str, ...]
    result: str
    child: str | None = None
    parent: str | None = None
    pairs: Callable[[], DataFrame] | None = None
    about: str = ""


@dataclass(frozen=True)
class Property:
    """A value of an entity: an SQL expression over its table's columns, or the (id, value) rows that pairs gives."""

    names: tuple[str, ...]
    kind: str  # atom, string, int, float, bool
    expr: str | None = None
    pairs: Callable[[], DataFrame] | None = None
    default: object = None
    about: str = ""


@dataclass
class Entity:
    name: str
    key: str
    table: Callable[[], DataFrame]
    initial: tuple[str, ...] = ()
    selectors: list[Selector] = field(default_factory=list)
    properties: list[Property] = field(default_factory=list)

    def find(self, name: str) -> Selector | Property | None:
        return next((x for x in (*self.selectors, *self.properties) if name in x.names), None)


@dataclass
class Catalog:
    """Entities by name. Names resolve before any plan is built, so errors come early."""

    spark: SparkSession
    entities: dict[str, Entity] = field(default_factory=dict)
    snapshot: str = ""
    starts: dict[str, tuple[str, Callable[..., DataFrame]]] = field(default_factory=dict)  # positional: name -> (kind, rows)
    edges: DataFrame | None = None  # links of a program graph

    def add(self, *entities: Entity) -> Catalog:
        for e in entities:
            self.entities[e.name] = e
        return self

    def initial(self) -> dict[str, str]:
        return {n: e.name for e in self.entities.values() for n in e.initial} | {n: k for n, (k, _) in self.starts.items()}

    def entity(self, name: str) -> Entity:
        if name not in self.entities:
            raise QueryError(f"unknown entity {name}")
        return self.entities[name]

    def resolve(self, entity: str, name: str) -> Selector | Property:
        found = self.entity(entity).find(name)
        if found is None:
            raise QueryError(f"{entity} has no selector or property {name}")
        return found

    def help(self, entity: str | None = None) -> DataFrame:
        """(entity, kind, name, synonyms, type, about) of all that can be named."""
        rows = []
        for e in self.entities.values():
            if entity in (None, e.name):
                rows += [(e.name, "initial selector", n, "", e.name, "") for n in e.initial]
                rows += [(e.name, "selector", s.names[0], ", ".join(s.names[1:]), s.result, s.about) for s in e.selectors]
                rows += [(e.name, "property", p.names[0], ", ".join(p.names[1:]), p.kind, p.about) for p in e.properties]
        return self.spark.createDataFrame(rows, "entity string, kind string, name string, synonyms string, type string, about string")
