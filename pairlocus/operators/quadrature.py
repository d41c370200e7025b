"""Expected values of bins from values at points of the distance r.

``edges(bin_id, r)`` are the bin edges in order; points are the edges, with midpoints for the
midpoint and Simpson rules.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def points(edges: list[float], rule: str) -> list[float]:
    """Where a rule evaluates the model."""
    middles = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]
    if rule in ("none", "midpoint"):
        return middles
    if rule == "trapezoid":
        return list(edges)
    if rule == "simpson":
        return sorted([*edges, *middles])
    raise ValueError(f"no such rule: {rule}")


def integrate(values: DataFrame, rule: str, by: list[str]) -> DataFrame:
    """``by, bin_id, value`` of ``values(by, point, value)`` with points numbered from 0."""
    order = Window.partitionBy(*by).orderBy("point")
    v = F.col("value")
    if rule in ("none", "midpoint"):
        return values.select(*by, F.col("point").alias("bin_id"), "value")
    if rule == "trapezoid":
        out = values.select(*by, F.col("point").alias("bin_id"), ((v + F.lead("value").over(order)) / 2).alias("value"))
        return out.where("value is not null")
    if rule == "simpson":
        sums = v / 6 + F.lead("value", 1).over(order) * 2 / 3 + F.lead("value", 2).over(order) / 6
        out = values.select(*by, "point", sums.alias("value")).where("point % 2 = 0 and value is not null")
        return out.select(*by, (F.col("point") / 2).cast("int").alias("bin_id"), "value")
    raise ValueError(f"no such rule: {rule}")
