"""Commands: ``python -m pairlocus.cli NAME ...``."""

import argparse
import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.genetics import haldane_edges, stat_label
from .operators import bootstrap, hstats, intervals, lattice, maps, pairs, views
from .operators.container import Statistics
from .scratch import written
from .sources import bed, vcf


def of_chromosome(rows: DataFrame, chrom: str, what: str) -> DataFrame:
    """Rows of one chromosome, named as ``chrom`` is; with or without ``chr`` is the same name."""
    kept = rows.where(F.regexp_replace("chrom", "^chr", "") == chrom.removeprefix("chr")).withColumn("chrom", F.lit(chrom))
    if kept.isEmpty() and not rows.isEmpty():
        raise ValueError(f"{what} has rows, but none of chromosome {chrom}")
    return kept


def map_of(spark: SparkSession, a, extent: int) -> DataFrame | None:
    """The chromosome's map: that of the file, one of a constant rate, or none."""
    if a.rec_map and a.r is not None:
        raise ValueError("give either a recombination map or a constant rate")
    if a.rec_map:
        return maps.checked_map(bed.read_recombination_map(spark, a.rec_map, a.chrom))
    if a.r is not None:
        line = [(a.chrom, 0.0, 0.0), (a.chrom, float(extent), haldane_edges([a.r])[0] * extent)]
        return spark.createDataFrame(line, "chrom string, bp double, cm double")
    return None


def parse_h2(spark: SparkSession, a) -> DataFrame:
    """Region statistics of a chromosome of a variant file, written as Parquet.

    Regions are named by the chromosome and their number in the file; they may overlap, each has
    its own right end. Without a file the whole chromosome is one. Bins are recombination fractions
    where there is a map (a file's, or that of a constant rate ``--r``) and base pairs where there
    is none; ``--bin_unit cM`` takes them as map distances. With a mutation map the mean rates of
    regions, which ``bootstrap_h2 --rates`` reads, are written to ``OUT_rates``. Denominators are
    counted over the mask (``--compute_denom 1``), over the variant sites (0, with
    ``--compute_snp_denom 1``), or left out (both 0). Those of a mask are counted on intervals; only
    a dense array of rates is gone through by position.
    """
    edges = bed.read_edges(spark, a.bins)
    mask = intervals.merge(of_chromosome(bed.read_bed(spark, a.bed, a.min_reg_len), a.chrom, "the mask"))
    extent = mask.agg(F.max("end").alias("end")).first()["end"] or 0
    windows = bed.read_numbered_windows(spark, a.regions, a.chrom) if a.regions else bed.whole_window(spark, a.chrom, extent)
    # Nothing lies beyond the mask's end.
    windows = windows.withColumns({c: F.least(c, F.lit(extent)).cast("long") for c in ("start", "l_end", "r_end")})
    wanted = bed.read_populations(spark, a.pops) if a.pops else [(s, s) for s in vcf.header(spark, a.vcf)]
    of_chromosome(vcf.read_positions(spark, a.vcf), a.chrom, "the variant file")
    sites = vcf.read_genotypes(spark, a.vcf, mask, samples=[s for s, _ in wanted], chrom=a.chrom)
    knots = map_of(spark, a, extent)
    unit = a.bin_unit or ("bp" if knots is None else "r")
    if unit not in ("r", "cM", "bp") or (unit == "bp") != (knots is None):
        raise ValueError(f"bins in {unit} {'need' if knots is None else 'go without'} a map")
    at, steps = "pos", haldane_edges(edges) if unit == "r" else edges
    if knots is not None:
        sites, at = maps.interpolate(sites, knots), "cm"
    rates = of_chromosome(bed.read_mutation_map(spark, a.mut_map, a.chrom), a.chrom, "the mutation map") if a.mut_map else None
    two, rate, region_rates = bool(a.compute_two_sample), "u" if a.mut_map else None, None
    if a.compute_denom and not (a.mut_map and bed.is_dense(spark, a.mut_map)):
        runs = lattice.weighted_runs(mask, rates)
        if knots is None and rates is None:
            denominators = pairs.mask_pair_counts(mask, windows, steps)
        else:
            denominators = lattice.interval_pair_sums(runs, windows, steps, knots)
        region_rates = lattice.interval_rates(runs, windows)
    else:
        covered = intervals.positions(mask) if a.compute_denom else sites.select("chrom", "pos", *([at] if knots is not None else []))
        if a.compute_denom and knots is not None:
            covered = maps.interpolate(covered, knots)
        if rates is not None:
            covered = maps.step_lookup(covered, rates).where("u is not null")
            region_rates = hstats.region_rates(hstats.of_windows(covered, windows), "u", windows.select("region").distinct())
        denominators = hstats.window_denominators(covered, windows, steps, at, rate)
    stats = hstats.window_statistics(sites, windows, len(wanted), steps, denominators, at, two)
    if not (a.compute_denom or a.compute_snp_denom):
        stats = stats.withColumn("denom", F.lit(None).cast("double"))
    stats = bootstrap.described(stats.withColumn("row", F.col("bin_id")), [p for _, p in wanted], edges, two)
    bed.write_statistics(stats, a.out, "chrom")
    if a.mut_map:
        bed.write_statistics(region_rates, f"{a.out}_rates")
    return bed.read_statistics(spark, a.out)


def bootstrap_h2(spark: SparkSession, a) -> DataFrame:
    """Means over regions and their covariances over replicates, written as Parquet."""
    tables = [bed.read_statistics(spark, p) for p in a.inputs]
    names, edges = bootstrap.description(tables)
    stats = bootstrap.combine(*[df.select("region", "row", "stat_ord", "num", "denom") for df in tables])
    rates = bed.read_statistics(spark, *a.rates) if a.rates else None
    bed.write_statistics(names, f"{a.out}/statistics")
    bed.write_statistics(edges, f"{a.out}/bins")
    reps = bootstrap.replicates(stats, a.num_reps, a.num_samples, rates, a.mean_mut, a.seed)
    bed.write_statistics(reps, f"{a.out}/replicates")
    bed.write_statistics(bootstrap.region_means(stats, rates, a.mean_mut), f"{a.out}/means")
    cov = bootstrap.covariances(bed.read_statistics(spark, f"{a.out}/replicates"))
    bed.write_statistics(cov, f"{a.out}/covs")
    return cov


def problem(spark: SparkSession, a):
    """Graph, parameters, edges, log-likelihood and the samples' demes of the fitting commands."""
    from .models import composite, graph

    with open(a.graph) as g, open(a.params) as p:
        g, parameters = graph.read_graph(g.read()), graph.read_parameters(p.read())
    for w in parameters.warnings:
        print(w)
    edges, samples = bed.read_edges(spark, a.bins), a.samples or graph.sampled(g)
    data = composite.observed(
        bed.read_statistics(spark, f"{a.data}/means"), bed.read_statistics(spark, f"{a.data}/covs"), len(edges) - 1, len(hstats.triangle(len(samples)))
    )
    return g, parameters, edges, composite.log_likelihood(g, parameters, samples, edges, a.u, data, bool(a.include_h)), samples


def fit_h2(spark: SparkSession, a) -> DataFrame:
    """Fits a graph's parameters (and the rate, if none is given) from many starts; writes the best."""
    import random

    from .models import composite, fitting, graph

    g, parameters, _, ll, _ = problem(spark, a)
    f = fitting.penalised(lambda p: -ll(p), *composite.bounds(parameters, a.u), parameters.greater)
    rng, first = random.Random(a.seed), graph.get_values(g, parameters)
    starts = [first] + [graph.perturbed(first, parameters, a.perturb, rng) for _ in range(a.starts - 1)]
    rate = [] if a.u is not None else [composite.RATE_START]
    table = spark.createDataFrame([(n, [*s, *rate]) for n, s in enumerate(starts)], "start long, x0 array<double>")
    fits = written(fitting.fit_starts(table, f, a.method, a.max_iter), "fits")
    best = fitting.best_fit(fits).first()
    values, u = (best["x"], a.u) if a.u is not None else (best["x"][:-1], best["x"][-1])
    info = {"method": a.method, "fopt": -best["fopt"], "num_iter": best["num_iter"], "func_calls": best["func_calls"], "u": u}
    with open(a.out, "w") as out:
        out.write(graph.write_graph(graph.with_values(g, parameters, values), info))
    print(json.dumps(info))
    return fits


def compute_uncerts(spark: SparkSession, a) -> DataFrame:
    """Standard errors and 95 % intervals of a fitted graph's parameters."""
    from .models import composite, fitting, graph

    if a.u is None:
        with open(a.graph) as text:
            a.u = graph.read_graph(text.read()).get("metadata", {}).get("opt_info", {}).get("u")
    if a.u is None:
        raise ValueError("neither the command nor the graph gives a mutation rate")
    g, parameters, edges, ll, samples = problem(spark, a)
    reps = None
    if a.uncert_method == "GIM":
        table = bed.read_statistics(spark, f"{a.data}/replicates")
        bins, statistics = len(edges) - 1, len(hstats.triangle(len(samples)))
        reps = composite.replicates_of(table, bins, statistics)
    p = graph.get_values(g, parameters)
    errors = fitting.uncertainties(spark, p, ll, reps, method=a.uncert_method)
    rows = [(n, float(v), float(e)) for n, v, e in zip(parameters.names, p, errors, strict=True)]
    out = views.intervals(spark.createDataFrame(rows, "name string, value double, se double"))
    bed.write_statistics(out, a.out)
    return out


def plot_params(spark: SparkSession, a) -> DataFrame:
    """Parameters of fitted graphs and their correlations, over fits of at least ``--min_ll``."""
    from .models import graph

    with open(a.params) as text:
        parameters = graph.read_parameters(text.read())
    names = a.names or parameters.names

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["value"].to_pylist():
                g = graph.read_graph(text)
                known = dict(zip(parameters.names, graph.get_values(g, parameters), strict=True))
                rows.append({n: known[n] for n in names} | {"ll": g.get("metadata", {}).get("opt_info", {}).get("fopt")})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.float64()) for n in [*names, "ll"]]))

    schema = ", ".join(f"`{n}` double" for n in [*names, "ll"])
    fits = spark.read.text(a.graphs, wholetext=True).mapInArrow(run, schema)
    if a.min_ll is not None:
        fits = fits.where(F.col("ll") >= a.min_ll)
    bed.write_statistics(fits, f"{a.out}/fits")
    fits = bed.read_statistics(spark, f"{a.out}/fits")
    bed.write_statistics(views.parameter_pairs(fits, names), f"{a.out}/pairs")
    out = views.parameter_correlations(fits, names)
    bed.write_statistics(out, f"{a.out}/correlations")
    return out


def setup_regions(spark: SparkSession, a) -> DataFrame:
    whole = spark.createDataFrame([(a.chrom, a.centromere, a.end)], "chrom string, centromere long, end long")
    out = intervals.arm_segments(whole, a.size)
    out.orderBy("start").select("start", "l_end", "r_end").coalesce(1).write.csv(a.out, sep="\t")
    return out


def parse_mut_vcf(spark: SparkSession, a) -> DataFrame:
    rates = vcf.read_mutation_rates(spark, a.input)
    rates.write.parquet(a.out)
    if a.bed:
        bed.write_bed(intervals.runs(spark.read.parquet(a.out)), a.bed)
    return rates


def parse_vcf_coverage(spark: SparkSession, a) -> DataFrame:
    out = vcf.coverage(spark, a.vcf)
    bed.write_bed(out, a.out)
    return out


def plot_h2(spark: SparkSession, a) -> DataFrame:
    """The table behind the figure, of some populations or of a graph's; with H2 beside the square of H.

    Of several data sets the rows are told apart by ``label``: those given, or else the folders' names.
    """
    labels = a.labels or [d.rstrip("/").rsplit("/", 1)[-1] for d in a.data]
    graphs = a.graph or []
    if len(set(labels)) < len(a.data) or len(labels) != len(a.data) or len(graphs) not in (0, 1, len(a.data)):
        raise ValueError("each data set needs a label of its own, and graphs are one for all or one for each")
    curves, ratios = [], []
    for n, (label, data) in enumerate(zip(labels, a.data, strict=True)):
        demes = None
        if graphs:
            from .models import graph

            with open(graphs[n % len(graphs)]) as text:
                demes = [x["name"] for x in graph.read_graph(text.read())["demes"]]
        statistics = Statistics.read(spark, data).subset(a.pops, demes, a.min_r, a.max_r)
        names = hstats.labels(spark, statistics.populations)
        named = names.select("stat_ord", stat_label(F.col("pop_i"), F.col("pop_j"), 99).alias("statistic"))
        curves.append(statistics.curves().join(named, "stat_ord", "left").withColumn("label", F.lit(label)))
        ratios.append(statistics.ratios().withColumn("label", F.lit(label)))
    out = reduce(DataFrame.unionByName, curves)
    if a.out:
        bed.write_statistics(out, a.out)
        bed.write_statistics(reduce(DataFrame.unionByName, ratios), f"{a.out}_ratios")
    out.orderBy("label", "stat_ord", "row").show(200)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    commands = p.add_subparsers(required=True)

    def command(f, *options: tuple):
        c = commands.add_parser(f.__name__, help=f.__doc__)
        c.set_defaults(run=f)
        for flag, kind, default in options:
            required = default is ...
            c.add_argument(flag, type=kind, required=required, default=None if required else default)
        return c

    command(parse_h2, ("--vcf", str, ...), ("--bed", str, ...), ("--rec_map", str, None), ("--mut_map", str, None), ("--pops", str, None), ("--regions", str, None), ("--r", float, None), ("--bin_unit", str, None), ("--bins", str, ...), ("--min_reg_len", int, None), ("--compute_denom", int, 1), ("--compute_snp_denom", int, 1), ("--compute_two_sample", int, 1), ("--chrom", str, ...), ("--out", str, ...))
    c = command(bootstrap_h2, ("--out", str, ...), ("--num_reps", int, None), ("--num_samples", int, None), ("--seed", int, 0), ("--mean_mut", float, None))
    c.add_argument("--inputs", nargs="+", required=True)
    c.add_argument("--rates", nargs="+")
    model = (("--data", str, ...), ("--graph", str, ...), ("--params", str, ...), ("--bins", str, ...), ("--u", float, None), ("--out", str, ...), ("--include_h", int, 0))
    c = command(fit_h2, *model, ("--perturb", float, 1.0), ("--starts", int, 8), ("--method", str, "NelderMead"), ("--max_iter", int, 500), ("--seed", int, 0))
    c.add_argument("--samples", nargs="+")
    c = command(compute_uncerts, *model, ("--uncert_method", str, "GIM"))
    c.add_argument("--samples", nargs="+")
    c = command(plot_params, ("--params", str, ...), ("--out", str, ...), ("--min_ll", float, None))
    c.add_argument("--graphs", nargs="+", required=True)
    c.add_argument("--names", nargs="+")
    command(setup_regions, ("--chrom", str, ...), ("--centromere", int, ...), ("--end", int, ...), ("--size", int, ...), ("--out", str, ...))
    command(parse_mut_vcf, ("--input", str, ...), ("--out", str, ...), ("--bed", str, None))
    command(parse_vcf_coverage, ("--vcf", str, ...), ("--out", str, ...))
    c = command(plot_h2, ("--min_r", float, None), ("--max_r", float, None), ("--out", str, None))
    c.add_argument("--data", nargs="+", required=True)
    for flag in ("--pops", "--graph", "--labels"):
        c.add_argument(flag, nargs="+")
    return p


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(SparkSession.builder.appName("pairlocus").getOrCreate(), a)


if __name__ == "__main__":
    main()
