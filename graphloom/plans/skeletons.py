"""Named query skeletons with placeholders, and queries kept for each kind of entity."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from graphloom.plans.lexer import QueryError

_HOLE = re.compile(r"\$[^$]*\$")
_CALL = re.compile(r"\s*([a-z]\w*)\s*\(\s*((?:`[^`]*`\s*(?:,\s*`[^`]*`\s*)*)?)\)\s*\.?\s*", re.S)
_SCHEMA = "name string, body string, owner string, comment string"


@dataclass
class Skeletons:
    """Skeletons by name: a body whose `$...$` parts are filled in order, an owner and a comment."""

    rows: dict[str, tuple[str, str, str]] = field(default_factory=dict)

    @staticmethod
    def check(body: str) -> None:
        if body.count("$") % 2:
            raise QueryError("a skeleton's $ come in pairs")

    def save(self, name: str, body: str, owner: str = "", comment: str = "") -> None:
        self.check(body)
        if name in self.rows:
            raise QueryError(f"there is a skeleton {name} already")
        self.rows[name] = body, owner, comment

    def update(self, name: str, body: str | None = None, comment: str | None = None) -> None:
        old, owner, said = self.get(name)
        self.check(body or old)
        self.rows[name] = (old if body is None else body), owner, (said if comment is None else comment)

    def delete(self, name: str) -> None:
        self.get(name)
        del self.rows[name]

    def get(self, name: str) -> tuple[str, str, str]:
        if name not in self.rows:
            raise QueryError(f"no skeleton {name}")
        return self.rows[name]

    def fill(self, name: str, *actuals: str) -> str:
        """The query that the skeleton makes of its actuals. What an actual brings is not filled again."""
        body = self.get(name)[0]
        holes = _HOLE.findall(body)
        if len(holes) != len(actuals):
            raise QueryError(f"{name} takes {len(holes)} parameters, not {len(actuals)}")
        left = iter(actuals)
        return _HOLE.sub(lambda _: next(left), body)

    @staticmethod
    def called(text: str) -> tuple[str, list[str]] | None:
        """(name, actuals) of name(`a`, `b`), else None."""
        m = _CALL.fullmatch(text)
        return m and (m[1], re.findall(r"`([^`]*)`", m[2]))

    def query(self, text: str) -> str:
        """The query of a skeleton's call, or the text itself if it is none."""
        call = self.called(text)
        return self.fill(call[0], *call[1]) if call and call[0] in self.rows else text

    def call_format(self, name: str) -> str:
        """How the skeleton is called, its placeholders named."""
        return f"{name}({', '.join(f'`{h[1:-1]}`' for h in _HOLE.findall(self.get(name)[0]))})"

    def complete(self, start: str) -> list[str]:
        return sorted(self.call_format(n) for n in self.rows if n.startswith(start))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, *r) for n, r in sorted(self.rows.items())], _SCHEMA)

    @classmethod
    def of_table(cls, rows: DataFrame) -> Skeletons:
        """Those of a table as table() gives; a registry is small by nature."""
        return cls({r["name"]: (r["body"], r["owner"], r["comment"]) for r in rows.collect()})


#: Queries offered for an entity under the cursor, by its kind.
PREDEFINED = {
    "function": {"calls": "@fun.calls", "callers": "@fun.called_by", "references": "@fun.refs", "arguments": "@fun.args", "variables": "@fun.vars", "all that it reaches": "@fun.(calls)+"},
    "variable": {"bindings": "@var.bindings", "references": "@var.refs", "function": "@var.fundef"},
    "record": {"fields": "@rec.fields", "references": "@rec.refs"},
    "field": {"record": "@field.record", "references": "@field.refs"},
    "macro": {"references": "@macro.refs"},
    "file": {"functions": "@file.funs", "records": "@file.records", "macros": "@file.macros", "includes": "@file.includes"},
    "expression": {"origin": "@expr.origin", "reach": "@expr.reach", "functions in it": "@expr.funs"},
}


def predefined(spark: SparkSession, kind: str | None = None) -> DataFrame:
    """(kind, title, query) of the kept queries, of one kind or all."""
    rows = [(k, t, q) for k, listed in PREDEFINED.items() if kind in (None, k) for t, q in listed.items()]
    return spark.createDataFrame(rows, "kind string, title string, query string")
