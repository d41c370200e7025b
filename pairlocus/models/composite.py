"""Composite likelihood of region means under a demographic graph, for fits and uncertainties.

The tables hold a row for each bin and statistic, so they are small whatever the data; what
takes long, the expected values under a graph, is evaluated in Spark tasks by ``fitting``.
"""

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import ancestry, theory
from .graph import Parameters, with_values

#: Where a mutation rate that is fitted starts, and its bounds. Fixed values.
RATE_START, RATE_BOUNDS = 1.3e-8, (1e-8, 1.6e-8)


@dataclass
class Observed:
    """Means by row (H last) and statistic, and inverse covariances by row; null rows weigh 0."""

    means: np.ndarray
    precisions: list[np.ndarray]


def rows_of(table: DataFrame, value: str, bins: int, statistics: int) -> np.ndarray:
    out = np.full((bins + 1, statistics), math.nan)
    for r in table.select("row", "stat_ord", value).collect():  # a row a bin and statistic
        out[r["row"], r["stat_ord"]] = math.nan if r[value] is None else r[value]
    return out


def replicates_of(table: DataFrame, bins: int, statistics: int) -> list[np.ndarray]:
    """``rows_of`` each replicate of ``rep, row, stat_ord, value``, in one job."""
    found: dict[int, np.ndarray] = {}
    for r in table.select("rep", "row", "stat_ord", "value").collect():  # a row a replicate, bin and statistic
        own = found.setdefault(r["rep"], np.full((bins + 1, statistics), math.nan))
        own[r["row"], r["stat_ord"]] = math.nan if r["value"] is None else r["value"]
    return [found[k] for k in sorted(found)]


def observed(means: DataFrame, covs: DataFrame, bins: int, statistics: int) -> Observed:
    x = rows_of(means, "mean", bins, statistics)
    cov = np.zeros((bins + 1, statistics, statistics))
    for r in covs.collect():  # a row a bin and pair of statistics
        cov[r["row"], r["stat_i"], r["stat_j"]] = 0.0 if r["cov"] is None else r["cov"]
    known = ~np.isnan(x).any(axis=1)
    # Covariances of fewer replicates than statistics have no inverse: the pseudo-inverse serves.
    precisions = [np.linalg.pinv(c) if k else np.zeros_like(c) for c, k in zip(cov, known, strict=True)]
    return Observed(np.where(known[:, None], x, 0.0), precisions)


def log_likelihood(
    graph: dict, parameters: Parameters, samples: list[str], edges: list[float], u: float | None, data: Observed,
    include_h: bool = False, rule: str = "trapezoid",
) -> Callable:
    """A function of parameter values (the rate last, where ``u`` is None) and, if given, other means."""

    def ll(p, means: np.ndarray | None = None) -> float:
        values, rate = (list(p), u) if u is not None else (list(p[:-1]), float(p[-1]))
        mu = ancestry.expected(with_values(graph, parameters, values), samples, rate, edges, rule)
        return theory.log_likelihood(data.means if means is None else means, mu, data.precisions, include_h)

    return ll


def bounds(parameters: Parameters, u: float | None) -> tuple[list[float], list[float]]:
    extra = u is None
    return parameters.lower + [RATE_BOUNDS[0]] * extra, parameters.upper + [RATE_BOUNDS[1]] * extra
