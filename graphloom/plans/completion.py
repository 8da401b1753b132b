"""What may come next in a query that is being typed."""

from __future__ import annotations

import re

from graphloom.functions.statistics import NAMES
from graphloom.plans.lexer import QueryError, Token, tokens
from graphloom.sources.catalog import Catalog, Selector

_NUMBER = ("==", "/=", "<", "=<", ">", ">=", "in")
_TEXT = ("==", "/=", "~", "like", "in")
_OPS = {"int": _NUMBER, "float": _NUMBER, "bool": ("==", "/="), "atom": _TEXT, "string": _TEXT}
_COMPARE = ("==", "/=", "=:=", "=/=", "=", "<", "=<", ">", ">=", "~")
_SETS = ("U", "I", "--")
_PARTIAL = re.compile(r"[@A-Za-z_][\w@]*$")


class _Place:
    """Where a prefix of a query stands: the type reached, and the brackets open around it with the types before them."""

    def __init__(self, catalog: Catalog):
        self.catalog, self.starts = catalog, catalog.initial()
        self.at: tuple[str | None, str | None] = (None, None)  # entity, kind of a value
        self.open: list[tuple[str, tuple]] = []
        self.variables: dict[str, tuple] = {}
        self.last: Token | None = None

    def base(self) -> tuple:
        return self.open[-1][1] if self.open else (None, None)

    def name(self, text: str) -> None:
        after_dot = self.last is not None and self.last.text == "."
        before = self.at if after_dot else self.base()
        found = self.catalog.entity(before[0]).find(text) if before[0] else None
        if text in self.variables:
            self.at = self.variables[text]
        elif found is not None:
            self.at = (found.result, None) if isinstance(found, Selector) else (None, found.kind)
        elif not after_dot and text in self.starts:
            self.at = (self.starts[text], None)
        elif after_dot or self.last is None:
            raise QueryError(f"nothing is called {text} here")
        else:
            self.at = (None, "bool" if text in ("true", "false") else "atom")  # a value

    def feed(self, t: Token) -> None:
        before = self.last.text if self.last else None
        if t.kind == "var" and before in ("->", "?", "/?"):
            self.variables.setdefault(t.text, self.at)
        elif t.kind == "var" and t.text not in self.variables:
            self.variables[t.text] = (None, "atom")
            self.at = self.variables[t.text]
        elif t.kind in ("name", "var"):
            self.name(t.text)
        elif t.kind == "op" and t.text in "([{":
            self.open.append((t.text, self.at))
        elif t.kind == "op" and t.text in ")]}":
            if not self.open or self.open[-1][0] != {")": "(", "]": "[", "}": "{"}[t.text]:
                raise QueryError(f"unexpected {t.text} at {t.at}")
            _, outer = self.open.pop()
            if t.text == "]":
                self.at = outer
        elif t.kind in ("set", "filter") or t.kind == "op" and t.text in _COMPARE:
            self.at = self.base()
        elif t.kind in ("int", "string", "quoted") and not (t.kind == "int" and before in (")", "}")):
            self.at = (None, "int" if t.kind == "int" else "string")
        self.last = t


def _members(catalog: Catalog, entity: str | None) -> list[tuple[str, str]]:
    if entity is None:
        return []
    e = catalog.entity(entity)
    return [(s.names[0], "selector") for s in e.selectors] + [(p.names[0], "property") for p in e.properties]


def complete(catalog: Catalog, text: str) -> list[tuple[str, str]]:
    """(token, kind) of what may follow, or of what may end the word begun. A prefix that no query has gives nothing."""
    m = _PARTIAL.search(text)
    begun = m.group() if m else ""
    place = _Place(catalog)
    try:
        for t in tokens(text[: len(text) - len(begun)])[:-1]:
            place.feed(t)
        names = _named(place)
        if names is not None:
            found = [(n, k) for n, k in names if n.startswith(begun)]
            if not begun or [n for n, _ in found] != [begun]:
                return found
            place.feed(tokens(begun)[0])
        elif begun:
            words = [(w, "operator") for w in ("and", "or", "in", "like", "all_in", "any_in", "U", "I")]
            return [(w, k) for w, k in words if w.startswith(begun)]
        return _after(place)
    except QueryError:
        return []


def _named(place: _Place) -> list[tuple[str, str]] | None:
    """The names that can stand here, or None where none can."""
    last, catalog = place.last, place.catalog
    starts = [(n, "initial selector") for n in sorted(place.starts)]
    variables = [(v, "variable") for v in sorted(place.variables)]
    inside = any(o == "[" for o, _ in place.open)
    if last is None:
        return starts
    if last.kind == "op":
        if last.text == ".":
            return _members(catalog, place.at[0]) + variables
        if last.text in ("->", "?", "/?"):
            return variables
        if last.text == ":":
            return [(n, "statistic") for n in NAMES] if place.at[1] in ("int", "float") else []
        if last.text in "({" and not inside:
            return _members(catalog, place.at[0]) + starts
        if last.text in "[({":
            return _members(catalog, place.at[0]) + [("not", "operator")] + variables + starts
        if last.text in _COMPARE:
            return _members(catalog, place.base()[0]) + variables + [("true", "value"), ("false", "value")]
    if last.kind == "filter":
        return _members(catalog, place.base()[0]) + [("not", "operator")] * (last.text in ("and", "or")) + variables
    if last.kind == "set":
        return _members(catalog, place.base()[0]) + starts
    return None


def _after(place: _Place) -> list[tuple[str, str]]:
    """What can follow a whole word or a closed bracket."""
    entity, kind = place.at
    inner = place.open[-1][0] if place.open else None
    out = []
    if entity is not None:
        out += [(x, "operator") for x in (".", "[", "(", "->")]
    if kind is not None and inner == "[":
        out += [(x, "operator") for x in _OPS.get(kind, ("==", "/="))]
    if kind in ("int", "float") and inner is None:
        out.append((":", "operator"))
    if inner == "[":
        out += [("and", "operator"), ("or", "operator")]
    else:
        out += [(x, "operator") for x in _SETS]
    if inner:
        out.append(({"(": ")", "[": "]", "{": "}"}[inner], "operator"))
    return out
