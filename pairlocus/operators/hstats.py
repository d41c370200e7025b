"""One- and two-sample heterozygosity, over sites (H) and over pairs of sites (H2)."""

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.genetics import different_alleles, heterozygous, ratio
from .intervals import locate
from .pairs import mean_product, pair_sums, windowed_pair_sums


def triangle(populations: int) -> list[tuple[int, int, int]]:
    """(stat_ord, i, j) for all i <= j, in order."""
    pairs = [(i, j) for i in range(populations) for j in range(i, populations)]
    return [(n, i, j) for n, (i, j) in enumerate(pairs)]


def labels(spark, populations: Sequence[str], two_sample: bool = True) -> DataFrame:
    """``stat_ord, pop_i, pop_j``."""
    rows = [(n, populations[i], populations[j]) for n, i, j in triangle(len(populations))]
    if not two_sample:
        rows = [(n, i, i) for n, i in enumerate(populations)]
    return spark.createDataFrame(rows, "stat_ord int, pop_i string, pop_j string")


def select_populations(sites: DataFrame, samples: Sequence[str], wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """``sites`` with genotypes of ``wanted`` (sample, population) pairs only, in that order."""
    names = [p for _, p in wanted]
    if len(set(names)) < len(names):
        raise ValueError("population names must be unique")
    missing = [s for s, _ in wanted if s not in samples]
    if missing:
        raise ValueError(f"samples that the sites don't have: {missing}")
    return sites.withColumn("gt", F.array(*[F.col("gt")[list(samples).index(s)] for s, _ in wanted]))


def one_locus(sites: DataFrame, populations: int, by: Sequence[str], two_sample: bool = True) -> DataFrame:
    """``by, stat_ord, num``: H as sums over sites (whole quarters, divided at the end).

    Tasks add up what they read, a block of statistics at a time; sums are shuffled, not sites.
    """
    by, made = list(by), quarters(populations, two_sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            codes = np.zeros(len(batch), np.int64)
            for c in by:
                own = batch[c].dictionary_encode("encode")
                codes = codes * len(own.dictionary) + own.indices.to_numpy()
            _, heads, codes = np.unique(codes, return_index=True, return_inverse=True)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(codes[order]) > 0))
            v = batch["alleles"].flatten().to_numpy().reshape(len(batch), -1)[order]
            first = 0
            for block in made(v):
                sums = np.add.reduceat(block, starts, axis=0)
                rows = pa.array(np.repeat(heads, sums.shape[1]))
                stats = np.tile(np.arange(first, first + sums.shape[1], dtype=np.int32), len(heads))
                yield pa.RecordBatch.from_arrays([*[batch[c].take(rows) for c in by], pa.array(stats), pa.array(sums.reshape(-1))], [*by, "stat_ord", "q"])
                first += sums.shape[1]

    rows = sites.select(*by, alleles(F.col("gt")).alias("alleles"))
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)
    sums = rows.mapInArrow(run, f"{fields}stat_ord int, q long")
    return sums.groupBy(*by, "stat_ord").agg((F.sum("q") / 4).alias("num"))


def _columns(populations: int, two_sample: bool) -> list[Column]:
    """Four times each statistic's difference at a site: whole numbers."""
    rows = triangle(populations) if two_sample else [(i, i, i) for i in range(populations)]
    gt = F.col("gt")
    return [heterozygous(gt[i]) * 4 if i == j else different_alleles(gt[i], gt[j]) for _, i, j in rows]


#: Statistics whose values a task makes at a time.
BLOCK = 64
#: Largest edges in a bucket of variant sites, which are sparse: fewer sites are copied, fewer sums made.
WIDER = 2


def alleles(gt: Column) -> Column:
    """The alleles of all samples, two a sample, in a byte each; -1 where one is missing."""
    missing = F.lit(-1).cast("tinyint")
    return F.flatten(F.transform(gt, lambda g: F.array(*[F.coalesce(g[a].cast("tinyint"), missing) for a in ("a0", "a1")])))


def quarters(populations: int, two_sample: bool, block: int = BLOCK) -> Callable[[np.ndarray], Iterator[np.ndarray]]:
    """A function from sites' alleles to four times their differences, a block of statistics at a time.

    A sample without an allele differs from none.
    """
    pairs = [(i, j) for _, i, j in triangle(populations)] if two_sample else [(i, i) for i in range(populations)]

    def run(v: np.ndarray) -> Iterator[np.ndarray]:
        a, b = v[:, ::2], v[:, 1::2]
        known = (a >= 0) & (b >= 0)
        for start in range(0, len(pairs), block):
            i, j = np.array(pairs[start : start + block]).T
            different = sum((x[:, i] != y[:, j]).astype(np.int64) for x in (a, b) for y in (a, b))
            own = 4 * (a[:, i] != b[:, i])
            yield np.where(known[:, i] & known[:, j], np.where(i == j, own, different), 0)

    return run


def two_locus_sums(
    sites: DataFrame, populations: int, edges: Sequence[float], by: Sequence[str], at: str, left: str | None, left_by: Sequence[str], two_sample: bool, method: str
) -> DataFrame:
    """``by, left_by, stat_ord, bin_id, num`` for groups with a difference: sites move once for all statistics.

    With the method ``halo`` alleles move, a byte each, and statistics are made where they are added up.
    """
    if method == "halo":
        # Where all alleles are the same there is no difference.
        rows = sites.withColumn("_alleles", alleles(F.col("gt"))).where(F.array_min("_alleles") != F.array_max("_alleles"))
        sums = pair_sums(rows, edges, list(by), at, "pos", "_alleles", left, left_by, method, WIDER * float(edges[-1]), quarters(populations, two_sample))
    else:
        quarters_of = _columns(populations, two_sample)
        values = [f"_d{n}" for n in range(len(quarters_of))]
        rows = sites.withColumns(dict(zip(values, quarters_of, strict=True)))
        sums = pair_sums(rows, edges, list(by), at, "pos", values, left, left_by, method)
    return sums.select(*by, *left_by, "stat_ord", "bin_id", (F.col("total") / 16).alias("num"))


def framed(groups: DataFrame, rows: int, statistics: int) -> DataFrame:
    """Each of ``groups`` with each ``bin_id`` from 0 and each ``stat_ord``."""
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (rows, statistics)]
    return groups.select("*", every[0].alias("bin_id")).select("*", every[1].alias("stat_ord"))


def null_safe(a: DataFrame, b: DataFrame, on: Sequence[str]) -> Column:
    same = F.lit(True)
    for c in on:
        same = same & a[c].eqNullSafe(b[c])
    return same


def two_locus(
    sites: DataFrame,
    populations: int,
    edges: Sequence[float],
    by: Sequence[str],
    at: str = "pos",
    left: str | None = None,
    left_by: Sequence[str] = (),
    phased: bool = False,
    two_sample: bool = True,
    method: str = "halo",
) -> DataFrame:
    """``by, left_by, stat_ord, bin_id, num``: H2 as sums over pairs of sites, zeros included."""
    if phased:
        raise NotImplementedError("there is no contract for phased statistics")
    sums = two_locus_sums(sites, populations, edges, by, at, left, left_by, two_sample, method)
    firsts = sites.where(left) if left else sites
    frame = framed(firsts.select(*by, *left_by).distinct(), len(edges) - 1, len(_columns(populations, two_sample)))
    on = [*by, *left_by, "stat_ord", "bin_id"]
    sums = sums.select(*[F.col(c).alias(c) for c in on], F.col("num").alias("num"))
    return frame.join(sums, null_safe(frame, sums, on), "left").select(*[frame[c] for c in on], F.coalesce(sums["num"], F.lit(0.0)).alias("num"))


def pair_denominators(
    covered: DataFrame, edges: Sequence[float], by: Sequence[str], at: str = "pos", left: str | None = None,
    left_by: Sequence[str] = (), rate: str | None = None, method: str = "halo",
) -> DataFrame:
    """``by, left_by, bin_id, denom``: callable pairs, or sums of u_i u_j with ``rate``."""
    sums = pair_sums(covered, edges, list(by), at, "pos", rate, left, left_by, method)
    return sums.withColumnRenamed("total", "denom")


def mutation_stats(covered: DataFrame, edges: Sequence[float], by: Sequence[str], rate: str, at: str = "pos") -> DataFrame:
    """Means of the rate and of its products, and the pairs within all bins together."""
    span = [edges[0], edges[-1]]
    pairs = pair_sums(covered, span, list(by), at).select(*by, F.col("total").alias("num_pairs"))
    return mean_product(covered, list(by), rate).join(pairs, list(by))


def means(nums: DataFrame, denoms: DataFrame, on: Sequence[str]) -> DataFrame:
    """``nums`` with ``denom`` and ``mean``, null where the denominator is none."""
    return nums.join(denoms, list(on), "left").withColumn("mean", ratio(F.col("num"), F.col("denom")))


def region_statistics(
    sites: DataFrame, covered: DataFrame, populations: int, edges: Sequence[float], at: str = "pos", rate: str | None = None,
    by: Sequence[str] = ("chrom",), left: str | None = None, regions: DataFrame | None = None, two_sample: bool = True,
    denominators: DataFrame | None = None,
) -> DataFrame:
    """``chrom, region, row_kind, bin_id, stat_ord, num, denom``: H2 rows by bin and one H row.

    ``region`` is a column of both inputs: the region of a pair is that of its first site, and
    its second site may lie beyond. The H row has bin_id -1. Pairs are made within ``by``; the
    boolean column ``left`` marks the sites of regions, if others are second sites only.

    Every one of ``regions(chrom, region)``, by default all with a covered position, has a row
    for each bin and statistic: sums without a pair, and denominators of regions that nothing
    covers, are 0. ``denominators(chrom, region, bin_id, denom)`` take the place of those of
    ``covered``.
    """
    key = ["region"]
    firsts = [df.where(left) if left else df for df in (sites, covered)]
    if regions is None:
        regions = firsts[1].select("chrom", "region").distinct()
    statistics = len(_columns(populations, two_sample))
    h2 = two_locus_sums(sites, populations, edges, by, at, left, key, two_sample, "halo")
    h2 = h2.groupBy("chrom", "region", "bin_id", "stat_ord").agg(F.sum("num").alias("num"))
    if denominators is None:
        d2 = pair_denominators(covered, edges, by, at, left, left_by=key, rate=rate)
        d2 = d2.groupBy("chrom", "region", "bin_id").agg(F.sum("denom").cast("double").alias("denom"))
        d1 = firsts[1].groupBy("chrom", "region").agg(F.lit(-1).alias("bin_id"), F.count("*").cast("double").alias("denom"))
        denominators = d2.unionByName(d1)
    h = one_locus(firsts[0], populations, ["chrom", "region"], two_sample).select("chrom", "region", F.lit(-1).alias("bin_id"), "stat_ord", "num")
    frame = framed(regions.select("chrom", "region"), len(edges), statistics).withColumn("bin_id", F.col("bin_id") - 1)
    return with_denominators(frame, h2.unionByName(h), denominators)


def of_windows(points: DataFrame, windows: DataFrame) -> DataFrame:
    """``points`` with ``region``, once for each window whose first sites they may be."""
    inside = windows.select("chrom", "start", F.least("l_end", "r_end").alias("end"), "region")
    return locate(points, inside).drop("start", "end")


def window_denominators(covered: DataFrame, windows: DataFrame, edges: Sequence[float], at: str = "pos", rate: str | None = None) -> DataFrame:
    """``chrom, region, bin_id, denom`` of windows that may overlap, from positions: pairs, or products of rates; sites at bin -1."""
    pairs = windowed_pair_sums(covered, windows, edges, at, [rate] if rate else None).select("chrom", "region", "bin_id", F.col("total").cast("double").alias("denom"))
    held = of_windows(covered.select("chrom", "pos"), windows)
    return pairs.unionByName(held.groupBy("chrom", "region").agg(F.lit(-1).alias("bin_id"), F.count("*").cast("double").alias("denom")))


def window_statistics(
    sites: DataFrame, windows: DataFrame, populations: int, edges: Sequence[float], denominators: DataFrame, at: str = "pos", two_sample: bool = True
) -> DataFrame:
    """``chrom, region, row_kind, bin_id, stat_ord, num, denom`` of ``windows(chrom, region, start, l_end, r_end)``, which may overlap.

    As ``region_statistics``, but each window has its own right end: second sites lie below it.
    """
    rows = sites.withColumn("_alleles", alleles(F.col("gt")))
    h2 = windowed_pair_sums(rows, windows, edges, at, "_alleles", WIDER * float(edges[-1]), quarters(populations, two_sample)).select("chrom", "region", "bin_id", "stat_ord", (F.col("total") / 16).alias("num"))
    held = of_windows(sites.select("chrom", "pos", "gt"), windows)
    h = one_locus(held, populations, ["chrom", "region"], two_sample).select("chrom", "region", F.lit(-1).alias("bin_id"), "stat_ord", "num")
    frame = framed(windows.select("chrom", "region").distinct(), len(edges), len(_columns(populations, two_sample))).withColumn("bin_id", F.col("bin_id") - 1)
    return with_denominators(frame, h2.unionByName(h), denominators)


def with_denominators(frame: DataFrame, nums: DataFrame, denominators: DataFrame) -> DataFrame:
    return (
        frame.join(nums, ["chrom", "region", "bin_id", "stat_ord"], "left")
        .join(denominators.select("chrom", "region", "bin_id", "denom"), ["chrom", "region", "bin_id"], "left")
        .select(
            "chrom",
            "region",
            F.when(F.col("bin_id") < 0, "H").otherwise("H2").alias("row_kind"),
            "bin_id",
            "stat_ord",
            F.coalesce("num", F.lit(0.0)).alias("num"),
            F.coalesce(F.col("denom").cast("double"), F.lit(0.0)).alias("denom"),
        )
    )


def region_rates(covered: DataFrame, rate: str, regions: DataFrame | None = None) -> DataFrame:
    """``region, num_sites, mean_mut`` of covered positions with a region; regions without any have 0 and null."""
    rows = covered.groupBy("region").agg(F.count(rate).alias("num_sites"), F.avg(rate).alias("mean_mut"))
    if regions is None:
        return rows
    return regions.select("region").join(rows, "region", "left").withColumn("num_sites", F.coalesce("num_sites", F.lit(0)))
