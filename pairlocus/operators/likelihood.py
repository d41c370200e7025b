"""Gaussian composite likelihood of tables of means, by row (bin)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bootstrap import H_ROW


def quadratic_forms(data: DataFrame, model: DataFrame, precision: DataFrame) -> DataFrame:
    """``row, ll``: -(x - mu)' P (x - mu) of each row, without a constant or a half.

    ``data`` and ``model`` have ``row, stat_ord, mean``; ``precision`` has
    ``row, stat_i, stat_j, value``.
    """
    d = data.alias("d").join(model.alias("m"), ["row", "stat_ord"]).select(
        "row", "stat_ord", (F.col("d.mean") - F.col("m.mean")).alias("dx")
    )
    i = d.select("row", F.col("stat_ord").alias("stat_i"), F.col("dx").alias("xi"))
    j = d.select("row", F.col("stat_ord").alias("stat_j"), F.col("dx").alias("xj"))
    return (
        precision.join(i, ["row", "stat_i"])
        .join(j, ["row", "stat_j"])
        .groupBy("row")
        .agg((-F.sum(F.col("xi") * F.col("value") * F.col("xj"))).alias("ll"))
    )


#: Eigenvalues below this share of the largest count as 0.
SINGULAR = 1e-12


def inverted(cov: np.ndarray) -> np.ndarray:
    """The inverse of a covariance matrix by its Cholesky factor; the pseudo-inverse of a singular one."""
    scale = np.sqrt(np.diag(cov))
    if (scale > 0).all():
        unit = cov / np.outer(scale, scale)
        try:
            factor = np.linalg.cholesky(unit)
            if np.diag(factor).min() ** 2 > SINGULAR * len(cov):
                half = np.linalg.solve(factor, np.eye(len(cov)))
                return half.T @ half / np.outer(scale, scale)
        except np.linalg.LinAlgError:
            pass
    return np.linalg.pinv(cov, rcond=SINGULAR, hermitian=True)


def precisions(cov: DataFrame) -> DataFrame:
    """``row, stat_i, stat_j, value``: the inverse of each row's matrix ``cov(row, stat_i, stat_j, cov)``.

    A row's matrix, one entry a pair of statistics, is inverted in one task. Where it is singular,
    as with fewer replicates than statistics, the pseudo-inverse serves; missing entries count as 0.
    """

    def one(table: pa.Table) -> pa.Table:
        i, j = table["stat_i"].to_numpy(), table["stat_j"].to_numpy()
        names = np.union1d(i, j)
        c = np.zeros((len(names), len(names)))
        c[np.searchsorted(names, i), np.searchsorted(names, j)] = np.nan_to_num(table["cov"].to_numpy())
        inverse = inverted((c + c.T) / 2)
        n = len(names)
        columns = [np.full(n * n, table["row"][0].as_py()), np.repeat(names, n), np.tile(names, n), inverse.reshape(-1)]
        return pa.table([pa.array(x) for x in columns], ["row", "stat_i", "stat_j", "value"])

    rows = cov.select(*[F.col(c).cast("long").alias(c) for c in ("row", "stat_i", "stat_j")], F.col("cov").cast("double").alias("cov"))
    return rows.groupBy("row").applyInArrow(one, "row long, stat_i long, stat_j long, value double")


def bin_likelihoods(data: DataFrame, model: DataFrame, cov: DataFrame) -> DataFrame:
    """``row, ll`` of means under a model's means, given their covariances."""
    return quadratic_forms(data, model, precisions(cov))


def total_likelihood(bins: DataFrame, include_h: bool = False) -> DataFrame:
    """``ll``: the sum over the rows of bins, and over the one-locus row if asked for. One row."""
    rows = bins if include_h else bins.where(F.col("row") != H_ROW)
    return rows.agg(F.sum("ll").alias("ll"))
