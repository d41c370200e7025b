"""Tables behind figures."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genetics import normal_quantile, ratio


def curves(means: DataFrame, cov: DataFrame, edges: list[float], confidence: float = 0.95) -> DataFrame:
    """``row, stat_ord, midpoint, mean, half_width``; the one-locus row has no midpoint."""
    middle = F.create_map(
        *[F.lit(x) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) for x in (k, (a + b) / 2)]
    )
    diagonal = cov.where("stat_i = stat_j").select("row", F.col("stat_i").alias("stat_ord"), "cov")
    return means.join(diagonal, ["row", "stat_ord"], "left").select(
        "row",
        "stat_ord",
        F.try_element_at(middle, F.col("row")).alias("midpoint"),
        "mean",
        (F.sqrt("cov") * normal_quantile(confidence)).alias("half_width"),
    )


def intervals(estimates: DataFrame, confidence: float = 0.95) -> DataFrame:
    """``estimates(name, value, se)`` with ``low`` and ``high``."""
    z = normal_quantile(confidence)
    return estimates.withColumns({"low": F.col("value") - z * F.col("se"), "high": F.col("value") + z * F.col("se")})


def parameter_correlations(fits: DataFrame, names: list[str], score: str = "ll", least: float | None = None) -> DataFrame:
    """``param_i, param_j, rho`` for all i < j, over fits of at least ``least``; null where one is constant."""
    kept = fits if least is None else fits.where(F.col(score) >= least)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    wide = kept.agg(*[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"r{n}") for n, (a, b) in enumerate(pairs)])
    return wide.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(a).alias("param_i"), F.lit(b).alias("param_j"), F.col(f"r{n}").alias("rho")) for n, (a, b) in enumerate(pairs)]
            )
        ).alias("r")
    ).select("r.*")


def parameter_pairs(fits: DataFrame, names: list[str], score: str = "ll", least: float | None = None) -> DataFrame:
    """``param_i, param_j, value_i, value_j`` and the score: a row for each fit and pair i < j, as drawn in a plane each."""
    kept = fits if least is None else fits.where(F.col(score) >= least)
    pairs = [
        F.struct(F.lit(a).alias("param_i"), F.lit(b).alias("param_j"), F.col(a).cast("double").alias("value_i"), F.col(b).cast("double").alias("value_j"))
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    ]
    return kept.select(F.explode(F.array(*pairs)).alias("p"), F.col(score).alias("score")).select("p.*", F.col("score").alias(score))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """``bin_id, n, freq``: bins closed on the left, the last on both sides; others are left out."""
    v = F.col(value)
    place: Column = F.lit(None).cast("int")
    for k, (a, b) in reversed(list(enumerate(zip(edges, edges[1:], strict=False)))):
        last = k == len(edges) - 2
        place = F.when((v >= a) & ((v <= b) if last else (v < b)), k).otherwise(place)
    counted = df.select(place.alias("bin_id")).where("bin_id is not null").groupBy("bin_id").agg(F.count("*").alias("n"))
    whole = counted.agg(F.sum("n").alias("all"))
    return counted.crossJoin(F.broadcast(whole)).select("bin_id", "n", (F.col("n") / F.col("all")).alias("freq"))  # one row


def quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(q.alias("q")).select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])


def h2_and_h_squared(means: DataFrame) -> DataFrame:
    """``row, stat_ord, mean, h_squared, ratio``: H2 of each bin beside the square of H, to which it falls."""
    h = means.where("row = -1").select("stat_ord", (F.col("mean") * F.col("mean")).alias("h_squared"))
    return means.where("row >= 0").join(h, "stat_ord").select(
        "row", "stat_ord", "mean", "h_squared", F.try_divide("mean", "h_squared").alias("ratio")
    )


def pair_counts(stats: DataFrame) -> DataFrame:
    """``row, pairs``: denominators of the bins summed over regions (they are the same for all statistics)."""
    return stats.where("row >= 0 and stat_ord = 0").groupBy("row").agg(F.sum("denom").alias("pairs"))


def arm_means(stats: DataFrame) -> DataFrame:
    """``arm, row, stat_ord, mean, h_squared`` of ``stats(region, row, stat_ord, num, denom, arm)``, and of all arms together as ``total``."""
    both = F.array(F.col("arm"), F.lit("total"))
    sums = stats.withColumn("arm", F.explode(both)).groupBy("arm", "row", "stat_ord").agg(F.sum("num").alias("n"), F.sum("denom").alias("d"))
    means = sums.select("arm", "row", "stat_ord", ratio(F.col("n"), F.col("d")).alias("mean"))
    h = means.where("row = -1").select("arm", "stat_ord", (F.col("mean") * F.col("mean")).alias("h_squared"))
    return means.where("row >= 0").join(h, ["arm", "stat_ord"]).select("arm", "row", "stat_ord", "mean", "h_squared")


def cross_product(stats: DataFrame, by: list[str], left: str, right: str) -> DataFrame:
    """H of two arms multiplied: the expectation of H2 between arms that segregate freely."""
    side = F.col("arm")
    return stats.groupBy(*by).agg(
        F.max(F.when(side == left, F.col("mean"))).alias("left_h"), F.max(F.when(side == right, F.col("mean"))).alias("right_h")
    ).withColumn("cross", F.col("left_h") * F.col("right_h"))
