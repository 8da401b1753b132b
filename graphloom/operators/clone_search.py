"""One door to the searches for duplicates: algorithms by name, options with defaults, filters, groups, a summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import clones
from graphloom.sources.scratch import settled

#: Options of each algorithm and their defaults.
OPTIONS = {
    "sw_metrics": {"deltas": clones.DELTAS, "block": (), "max_rank": clones.MAX_RANK, "filters": ()},
    "matrix": {"diff_limit": clones.DIFF_LIMIT, "gap": 0, "measure": "dice", "subject": None, "least": 1, "filters": ()},
    "suffix_tree": {"minlen": clones.MIN_LENGTH, "minnum": clones.MIN_NUMBER, "filters": ()},
    "exact": {"minnum": clones.MIN_NUMBER},
}
#: Words that a copy has at least, and share of calls that two copies have in common at least.
LEAST_TOKENS, CALL_RATIO = 20, 0.1


def few_tokens(pairs_tokens: str = "tokens") -> Column:
    """A filter: one of the two has too few words."""
    return (F.col(f"{pairs_tokens}1") < LEAST_TOKENS) | (F.col(f"{pairs_tokens}2") < LEAST_TOKENS)


def different_calls(calls: str = "calls") -> Column:
    """A filter: the two sets of called functions hardly overlap. Two without calls are alike."""
    a, b = F.col(f"{calls}1"), F.col(f"{calls}2")
    every = F.size(F.array_union(a, b))
    return (every > 0) & (F.size(F.array_intersect(a, b)) < CALL_RATIO * every)


def too_deep(depth: str, most: int) -> Column:
    """A filter: one of the two nests deeper than `most`."""
    return (F.col(f"{depth}1") > most) | (F.col(f"{depth}2") > most)


def rejected(found: DataFrame, filters: tuple[Column, ...]) -> DataFrame:
    """found less the rows of which any filter is true; a filter that is null does not reject."""
    for test in filters:
        found = found.where(~F.coalesce(test, F.lit(False)))
    return found


@dataclass(frozen=True)
class Clones:
    """What a search gave: `found`, one row for each pair of classes, run or class, and how many units it looked at."""

    found: DataFrame
    algorithm: str
    analysed_candidates_num: int

    def summary(self) -> dict[str, int]:
        return {"analysed_candidates_num": self.analysed_candidates_num, "detected_clones_num": self.found.count()}

    def groups(self) -> DataFrame:
        """(group_id, member): maximal cliques of the pairs of classes that sw_metrics found, with no pair of a class with itself."""
        if self.algorithm != "sw_metrics":
            raise ValueError(f"{self.algorithm} gives no pairs of units")
        return clones.clique_groups(self.found.select("a", "b"))

    def group(self, group_id: str) -> DataFrame:
        """The members of one group."""
        return self.groups().where(F.col("group_id") == group_id).select("member")


def options_of(algorithm: str, given: dict) -> dict:
    """Defaults and what is given; unknown names and values out of range are errors."""
    if algorithm not in OPTIONS:
        raise ValueError(f"no algorithm {algorithm}; there are {', '.join(OPTIONS)}")
    unknown = set(given) - set(OPTIONS[algorithm])
    if unknown:
        raise ValueError(f"{algorithm} has no option {', '.join(sorted(unknown))}")
    out = OPTIONS[algorithm] | given
    if "diff_limit" in out and not 0 <= out["diff_limit"] < 1:
        raise ValueError("diff_limit must be from 0 to 1")
    for name in ("minlen", "minnum", "max_rank", "least"):
        if name in out and out[name] < 1:
            raise ValueError(f"{name} must be 1 or more")
    return out


def _by_measures(units: DataFrame, o: dict) -> DataFrame:
    deltas = {m: d for m, d in o["deltas"].items() if m in units.columns}
    if not deltas:
        raise ValueError("units have none of the measures")
    pairs = clones.close_classes(units, list(o["block"]), deltas)
    ranks = clones.ranked(pairs, [(f"{m}1", f"{m}2", d) for m, d in deltas.items()])
    return ranks.where(F.col("rank") <= o["max_rank"])


def _by_matrix(units: DataFrame, o: dict) -> DataFrame:
    runs = clones.clone_matrix(units, 1 - o["diff_limit"], o["gap"], o["measure"]).where(F.col("units") >= o["least"])
    if o["subject"] is None:
        return runs
    parent, first, last = o["subject"]
    touches = lambda s: (F.col(f"parent_{s}") == parent) & (F.col(f"start_{s}") <= last) & (F.col(f"start_{s}") + F.col("units") > first)
    return runs.where(touches("a") | touches("b"))


def _by_runs(units: DataFrame, o: dict) -> DataFrame:
    runs = clones.without_contained(clones.token_runs(units.select("id", "text"), o["minlen"]), ["first", "id"], "start", "tokens")
    if o["minnum"] <= 2:
        return runs
    place = ["first", "first_start", "tokens"]
    many = runs.groupBy(*place).agg((F.count("*") + 1).alias("n")).where(F.col("n") >= o["minnum"]).drop("n")
    return runs.join(many, place, "left_semi")


_SEARCHES: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "sw_metrics": _by_measures, "matrix": _by_matrix, "suffix_tree": _by_runs, "exact": lambda units, o: clones.exact_groups(units, o["minnum"]),
}


def find_clones(units: DataFrame, algorithm: str = "sw_metrics", **options) -> Clones:
    """Duplicates among units, by an algorithm and its OPTIONS.

    sw_metrics: units(id, block columns, measures named in `deltas`), pairs of classes by rank. matrix: units(id, parent, at,
    text), runs of similar neighbours; `subject` (parent, first, last) keeps those that touch its places. suffix_tree:
    units(id, text), repeated runs of words, of which `minnum` copies start and end alike. exact: units(id, text).
    Filters are columns over what is found, true for what is left out. What is found is computed once.
    """
    chosen = options_of(algorithm, options)
    found = rejected(_SEARCHES[algorithm](units, chosen), tuple(chosen.get("filters", ())))
    return Clones(settled(found), algorithm, units.count())
