"""Statistics over regions, and resampling of regions with replacement.

Region tables are long: ``region, row, stat_ord, num, denom`` with one ``row`` a bin, the
one-locus row being ``H_ROW``. A region that a replicate draws twice counts twice.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genetics import ratio
from .hstats import triangle

H_ROW = -1


def combine(*tables: DataFrame) -> DataFrame:
    """All regions of several tables; reading fails where two have the same region."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    key = ["region", "row", "stat_ord"]
    twice = out.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return out.join(
        twice.select(*[F.col(c).alias(f"_{c}") for c in key]),
        [F.col(c) == F.col(f"_{c}") for c in key],
        "left",
    ).where(F.when(F.col("_region").isNotNull(), F.raise_error(F.lit("a region is in two tables"))).isNull()).drop(
        *[f"_{c}" for c in key]
    )


def described(stats: DataFrame, populations: list[str], edges: list[float], two_sample: bool = True) -> DataFrame:
    """``stats`` with what its rows are: populations of the statistic, edges of the bin (null for H)."""
    pairs = triangle(len(populations)) if two_sample else [(n, n, n) for n in range(len(populations))]
    ends = [F.array(*[F.lit(populations[p[k]]) for p in pairs]) for k in (1, 2)]
    sides = [F.array(*map(F.lit, e)) for e in (edges[:-1], edges[1:])]
    return stats.withColumns(
        {n: F.get(e, F.col("stat_ord")) for n, e in zip(("pop_i", "pop_j"), ends, strict=True)}
        | {n: F.get(e, F.when(F.col("row") >= 0, F.col("row"))) for n, e in zip(("low", "high"), sides, strict=True)}
    )


def description(tables: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``stat_ord, pop_i, pop_j`` and ``row, low, high`` of several tables; fails where they don't agree."""
    found = []
    for key, columns in (("stat_ord", ["pop_i", "pop_j"]), ("row", ["low", "high"])):
        each = [df.select(key, *columns).distinct().withColumn("table", F.lit(n)) for n, df in enumerate(tables)]
        rows = each[0]
        for df in each[1:]:
            rows = rows.unionByName(df)
        same = rows.groupBy(key).agg(F.count_distinct("table").alias("tables"), F.count_distinct(F.struct(*columns)).alias("kinds"))
        if same.where((F.col("tables") != len(tables)) | (F.col("kinds") != 1)).count():
            raise ValueError(f"tables with different {' and '.join(columns)}")
        found.append(rows.select(key, *columns).distinct())
    return found[0], found[1]


def populations_of(names: DataFrame) -> list[str]:
    """Populations in order, from ``stat_ord, pop_i, pop_j``."""
    rows = names.where("pop_i = pop_j").orderBy("stat_ord").collect()  # a row a population
    return [r["pop_i"] for r in rows]


def subset_populations(table: DataFrame, names: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows of the statistics of ``wanted`` populations, numbered anew in their order."""
    number = {}
    for r in names.collect():  # a row a statistic
        number[r["pop_i"], r["pop_j"]] = number[r["pop_j"], r["pop_i"]] = r["stat_ord"]
    missing = [p for p in wanted if (p, p) not in number]
    if missing:
        raise ValueError(f"populations that the table doesn't have: {missing}")
    pairs = [(wanted[i], wanted[j]) for _, i, j in triangle(len(wanted))]
    return subset_statistics(table, [number[p] for p in pairs if p in number])


def rate_factor(rates: DataFrame, by: list[str], target: float | None = None) -> DataFrame:
    """``by, factor``: the squared mean rate over regions of ``region, num_sites, mean_mut``.

    ``target`` takes the place of the weighted mean.
    """
    mean = F.sum(F.col("num_sites") * F.col("mean_mut")) / F.sum("num_sites")
    mean = F.lit(target) if target is not None else mean
    return rates.groupBy(*by).agg((mean * mean).alias("factor"))


def scaled(factor: Column | None) -> Column:
    """The denominator in units of pairs: products of rates are divided by the squared mean.

    The one-locus row counts sites and is never scaled.
    """
    d = F.col("denom")
    return d if factor is None else F.when(F.col("row") == H_ROW, d).otherwise(d / factor)


def region_means(stats: DataFrame, rates: DataFrame | None = None, target: float | None = None) -> DataFrame:
    """``row, stat_ord, mean``: sums over regions divided; null without a denominator."""
    factor = None
    if rates is not None:
        stats = stats.crossJoin(F.broadcast(rate_factor(rates, [], target)))  # one row
        factor = F.col("factor")
    return (
        stats.withColumn("d", scaled(factor))
        .groupBy("row", "stat_ord")
        .agg(ratio(F.sum("num"), F.sum("d")).alias("mean"))
    )


def numbered(regions: DataFrame) -> DataFrame:
    """``region, region_ord``: distinct regions numbered from 0 by name."""
    from pyspark.sql import Window

    return regions.select("region").distinct().withColumn(
        "region_ord", F.row_number().over(Window.orderBy("region")) - 1
    )


def draws(regions: DataFrame, reps: int, samples: int, seed: int = 0) -> DataFrame:
    """``rep, draw, region_ord``: seeded draws with replacement.

    A draw is the first 60 bits of the MD5 of seed, rep and draw, joined by colons, modulo the number of regions.
    """
    spark = regions.sparkSession
    n = regions.agg(F.count("*").alias("n"))
    text = F.concat_ws(":", F.lit(seed).cast("string"), F.col("rep").cast("string"), F.col("draw").cast("string"))
    return (
        spark.range(reps)
        .withColumnRenamed("id", "rep")
        .withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(samples - 1).cast("long"))))
        .crossJoin(F.broadcast(n))  # one row
        .select("rep", "draw", F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.col("n")).alias("region_ord"))
    )


def region_vectors(stats: DataFrame, keys: list[tuple[int, int]]) -> DataFrame:
    """``region, num, d``: a region's values in the order of ``keys(row, stat_ord)``, 0 where it has none, as binary doubles."""
    place = {k: n for n, k in enumerate(keys)}

    def one(table: pa.Table) -> pa.Table:
        at = np.array([place[k] for k in zip(table["row"].to_pylist(), table["stat_ord"].to_pylist(), strict=True)])
        vectors = []
        for c in ("num", "d"):
            values = np.zeros(len(place))
            np.add.at(values, at, pc.fill_null(table[c], 0.0).to_numpy())
            vectors.append(pa.array([values.tobytes()], pa.binary()))
        return pa.table([table["region"].slice(0, 1), *vectors], ["region", "num", "d"])

    rows = stats.select("region", "row", "stat_ord", F.col("num").cast("double").alias("num"), F.col("d").cast("double").alias("d"))
    return rows.groupBy("region").applyInArrow(one, "region string, num binary, d binary")


#: Replicates whose sums a task holds at a time.
REPLICATES = 1 << 10


def replicates(
    stats: DataFrame,
    reps: int | None = None,
    samples: int | None = None,
    rates: DataFrame | None = None,
    target: float | None = None,
    seed: int = 0,
) -> DataFrame:
    """``rep, row, stat_ord, value``: ratios of sums over drawn regions, all replicates in one pass.

    By default there are as many replicates, and draws in each, as regions. A region's values are
    one vector, which goes with the list of the replicates that draw it and how often. Tasks
    multiply and add up what they have as matrices, and only sums of whole replicates are shuffled.
    With ``rates``, denominators are divided by the squared mean rate of all regions.
    """
    regions = numbered(stats)
    if reps is None or samples is None:
        n = regions.count()
        reps, samples = reps or n, samples or n
    factor = None
    if rates is not None:
        stats = stats.crossJoin(F.broadcast(rate_factor(rates, [], target)))  # one row
        factor = F.col("factor")
    keys = sorted((r["row"], r["stat_ord"]) for r in stats.select("row", "stat_ord").distinct().collect())  # a row a bin and statistic
    drawn = (
        draws(regions, reps, samples, seed)
        .groupBy("region_ord", "rep")
        .agg(F.count("*").alias("times"))
        .groupBy("region_ord")
        .agg(F.collect_list(F.struct("rep", "times")).alias("drawn"))  # an entry a replicate
        .join(regions, "region_ord")
        .select("region", "drawn.rep", "drawn.times")
    )
    width, part = len(keys), REPLICATES

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]  # a task's regions, of a few kilobytes each
        if not held:
            return
        table = pa.Table.from_batches(held)
        values = np.hstack([np.stack([np.frombuffer(v, float) for v in table[c].to_pylist()]) for c in ("num", "d")])
        lists = [table[c].combine_chunks() for c in ("rep", "times")]
        region = np.repeat(np.arange(len(table)), np.diff(lists[0].offsets.to_numpy()))
        rep, times = (x.flatten().to_numpy() for x in lists)
        for low in range(0, reps, part):
            high = min(low + part, reps)
            mine = (rep >= low) & (rep < high)
            counts = np.zeros((high - low, len(table)))
            counts[rep[mine] - low, region[mine]] = times[mine]
            found = np.flatnonzero(counts.any(axis=1))
            sums = counts[found] @ values
            yield pa.RecordBatch.from_arrays([pa.array(found + low), pa.array([r.tobytes() for r in sums], pa.binary())], ["rep", "sums"])

    def ratios(table: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(v, float) for v in table["sums"].to_pylist()], axis=0)
        num, d = sums[:width], sums[width:]
        value = np.divide(num, d, out=np.zeros(width), where=d != 0)
        rows, stat = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
        return pa.table([pa.array([table["rep"][0].as_py()] * width, pa.int64()), rows, stat, pa.array(value, mask=d == 0)], ["rep", "row", "stat_ord", "value"])

    vectors = region_vectors(stats.withColumn("d", scaled(factor)), keys).join(drawn, "region")
    return vectors.mapInArrow(summed, "rep long, sums binary").groupBy("rep").applyInArrow(ratios, "rep long, row long, stat_ord long, value double")


def covariances(reps: DataFrame) -> DataFrame:
    """``row, stat_i, stat_j, cov``: sample covariances over replicates, i <= j and i >= j."""
    pairs = (
        reps.groupBy("rep", "row")
        .agg(F.collect_list(F.struct("stat_ord", "value")).alias("s"))  # a row's statistics: few
        .select("row", "s", F.explode("s").alias("a"))
        .select("row", "a", F.explode("s").alias("b"))
    )
    return pairs.groupBy("row", F.col("a.stat_ord").alias("stat_i"), F.col("b.stat_ord").alias("stat_j")).agg(
        F.covar_samp("a.value", "b.value").alias("cov")
    )


def replace_denominators(stats: DataFrame, denoms: DataFrame) -> DataFrame:
    """``stats`` with the denominators of ``denoms(region, row, denom)``."""
    return stats.drop("denom").join(denoms, ["region", "row"], "left")


def subset_statistics(table: DataFrame, keep: list[int]) -> DataFrame:
    """Rows of some statistics, numbered anew in the order given; covariances by both ends."""
    number = F.create_map(*[F.lit(x) for n, s in enumerate(keep) for x in (s, n)])
    columns = [c for c in ("stat_ord", "stat_i", "stat_j") if c in table.columns]
    for c in columns:
        table = table.where(F.col(c).isin(keep)).withColumn(c, number[F.col(c)])
    return table


def subset_bins(table: DataFrame, edges: list[float], low: float, high: float) -> DataFrame:
    """Rows of the bins within [low, high]; the one-locus row always stays."""
    inside = [k for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a >= low and b <= high]
    return table.where((F.col("row") == H_ROW) | F.col("row").isin(inside))
