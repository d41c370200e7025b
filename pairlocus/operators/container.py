"""Statistics of a bootstrap as one thing: means, covariances, and what their rows are."""

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from .bootstrap import H_ROW, populations_of, subset_bins, subset_populations
from .hstats import labels
from .views import curves, h2_and_h_squared


@dataclass(frozen=True)
class Statistics:
    """``means(row, stat_ord, mean)`` and ``covs(row, stat_i, stat_j, cov)`` of populations and bin edges.

    Populations and edges are short lists by their nature; the tables stay DataFrames.
    """

    means: DataFrame
    covs: DataFrame
    populations: tuple[str, ...]
    edges: tuple[float, ...]

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Statistics":
        """What ``bootstrap_h2`` has written."""
        means, covs, names, bins = (spark.read.parquet(f"{path}/{x}") for x in ("means", "covs", "statistics", "bins"))
        rows = bins.where(f"row != {H_ROW}").orderBy("row").collect()
        edges = [r["low"] for r in rows] + [r["high"] for r in rows[-1:]]
        return cls(means, covs, tuple(populations_of(names)), tuple(edges))

    def subset(
        self, populations: Sequence[str] | None = None, demes: Iterable[str] | None = None, low: float | None = None, high: float | None = None
    ) -> "Statistics":
        """Some populations in the order given, or those that are among ``demes``; bins within [low, high].

        Bins keep their row numbers; the one-locus row always stays.
        """
        out = self
        if demes is not None:
            known = set(demes)
            populations = [p for p in self.populations if p in known]
        if populations is not None:
            names = labels(self.means.sparkSession, self.populations)
            means, covs = (subset_populations(df, names, list(populations)) for df in (self.means, self.covs))
            out = replace(out, means=means, covs=covs, populations=tuple(populations))
        if low is not None or high is not None:
            ends = (0.0 if low is None else low, float("inf") if high is None else high)
            means, covs = (subset_bins(df, list(self.edges), *ends) for df in (out.means, out.covs))
            out = replace(out, means=means, covs=covs)
        return out

    def curves(self, confidence: float = 0.95) -> DataFrame:
        """Means by bin with half widths of their intervals."""
        return curves(self.means, self.covs, list(self.edges), confidence)

    def ratios(self) -> DataFrame:
        """H2 beside the square of H."""
        return h2_and_h_squared(self.means)

    def __repr__(self) -> str:
        return f"Statistics of {', '.join(self.populations)} in {len(self.edges) - 1} bins from {self.edges[0]:g} to {self.edges[-1]:g}"
