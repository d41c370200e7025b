"""Scalar expressions: map functions, genotype differences, bins, quadrature points."""

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def haldane(r: Column) -> Column:
    """Map distance in cM of a recombination fraction."""
    return -50.0 * F.ln(1 - 2 * r)


def inverse_haldane(cm: Column) -> Column:
    """Recombination fraction of a map distance in cM."""
    return (1 - F.exp(-cm / 50.0)) / 2


def haldane_edges(r_edges: list[float]) -> list[float]:
    """The same map function for a driver-side list of bin edges."""
    return [-50.0 * math.log(1 - 2 * r) for r in r_edges]


def n_choose_2(n: Column) -> Column:
    return F.floor(n * (n - 1) / 2).cast("long")


def constant_map(position: Column, r: float) -> Column:
    """Map position in cM under one recombination fraction per base pair."""
    return position * F.lit(haldane_edges([r])[0])


def log_edges(low: float, high: float, count: int) -> list[float]:
    """``count`` edges from 10^low to 10^high, evenly spaced in the exponent."""
    return [10 ** (low + (high - low) * i / (count - 1)) for i in range(count)]


#: Default bin edges in r. 21 from 1e-6 to 1e-1, and 17 from 1e-6 to 1e-2.
DEFAULT_EDGES = log_edges(-6, -1, 21)
CONTAINER_EDGES = log_edges(-6, -2, 17)


def different_alleles(a: Column, b: Column) -> Column:
    """Of the four comparisons of an allele of ``a`` with one of ``b``, how many differ."""
    return sum(((a[x] != b[y]).cast("long") for x in ("a0", "a1") for y in ("a0", "a1")), F.lit(0))


def heterozygous(gt: Column) -> Column:
    return (gt["a0"] != gt["a1"]).cast("long")


def ratio(num: Column, denom: Column) -> Column:
    """num / denom, null where the denominator is 0 or null."""
    return num / F.nullif(denom.cast("double"), F.lit(0.0))


def normal_quantile(confidence: float) -> float:
    """How many standard errors a two-sided interval of that confidence spans on each side."""
    return NormalDist().inv_cdf(0.5 + confidence / 2)


def stat_label(i: Column, j: Column, letters: int = 3) -> Column:
    """``Abc`` for one population, ``Abc-Def`` for two, by their first letters."""
    a, b = F.substring(i, 1, letters), F.substring(j, 1, letters)
    return F.when(i == j, a).otherwise(F.concat_ws("-", a, b))
