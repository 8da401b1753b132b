"""Statistics of a column of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The names of each statistic.
NAMES = {
    "minimum": "min", "min": "min", "maximum": "max", "max": "max", "sum": "sum", "mean": "avg", "average": "avg", "avg": "avg",
    "median": "median", "med": "median", "variance": "var", "var": "var", "standard_deviaton": "sd", "standard_deviation": "sd", "sd": "sd",
}


def statistic(name: str, value: Column) -> Column:
    """An aggregate. Of no values the sum is 0, the mean NaN and others null; the variance of one value is 0."""
    kind = NAMES[name]
    if kind == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    if kind == "avg":
        return F.coalesce(F.avg(value), F.lit(float("nan")))
    if kind in ("var", "sd"):
        var = F.when(F.count(value) == 1, F.lit(0.0)).otherwise(F.var_samp(value))
        return var if kind == "var" else F.sqrt(var)
    return {"min": F.min, "max": F.max, "median": F.median}[kind](value)
