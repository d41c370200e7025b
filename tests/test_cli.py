import gzip
import random

import pytest

from pairlocus import cli
from pairlocus.functions.genetics import haldane_edges
from pairlocus.models import ancestry, graph
from pairlocus.operators.container import Statistics


@pytest.fixture
def files(tmp_path):
    rng = random.Random(5)
    positions = sorted(rng.sample(range(1, 4000), 60))
    lines = ["##fileformat=VCFv4.2", "##contig=<ID=1,length=4000>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB"]
    for p in positions:
        gts = "\t".join(f"{rng.randint(0, 1)}/{rng.randint(0, 1)}" for _ in "AB")
        lines.append(f"1\t{p}\t.\tA\tC\t.\t.\tMR=1.0\tGT\t{gts}")
    (tmp_path / "v.vcf.gz").write_bytes(gzip.compress("\n".join(lines).encode()))
    (tmp_path / "m.bed").write_text("1\t0\t1500\n1\t2000\t4000\n")
    (tmp_path / "map").write_text("Position(bp) Map(cM)\n0 0.0\n4000 0.4\n")
    (tmp_path / "bins").write_text("0.0 1e-5 1e-4 1e-3\n")
    (tmp_path / "regions").write_text("0 1000 4000\n1000 2000 4000\n2000 4000 4000\n")
    (tmp_path / "pops").write_text("B Y\nA X\n")
    return tmp_path, [p - 1 for p in positions if p - 1 < 1500 or p - 1 >= 2000]


def test_statistics_and_bootstrap(spark, files):
    d, sites = files
    common = ["--vcf", f"{d}/v.vcf.gz", "--bed", f"{d}/m.bed", "--regions", f"{d}/regions", "--bins", f"{d}/bins", "--chrom", "1"]
    cli.main(["parse_h2", *common, "--rec_map", f"{d}/map", "--pops", f"{d}/pops", "--out", f"{d}/stats"])
    stats = spark.read.parquet(f"{d}/stats")
    h = stats.where("row_kind = 'H' and stat_ord = 0").collect()
    assert sum(r.denom for r in h) == 3500
    assert stats.select("region").distinct().count() == 3 and stats.select("stat_ord").distinct().count() == 3
    pairs_in = stats.where("row_kind = 'H2' and stat_ord = 0").groupBy("row").sum("denom").collect()
    covered = [p for p in range(4000) if p < 1500 or p >= 2000]
    edges = haldane_edges([0.0, 1e-5, 1e-4, 1e-3])
    inside = set(covered)
    # One position is 1e-4 cM, so a bin is a range of whole distances.
    for r in pairs_in:
        lo, hi = edges[r.row] / 1e-4, edges[r.row + 1] / 1e-4
        want = sum(1 for k in range(1, 4000) if lo <= k < hi for p in covered if p + k in inside)
        assert r["sum(denom)"] == pytest.approx(want, rel=0.01)
    cli.main(["bootstrap_h2", "--inputs", f"{d}/stats", "--out", f"{d}/boot", "--num_reps", "5", "--num_samples", "3"])
    assert spark.read.parquet(f"{d}/boot/means").count() == 4 * 3
    assert spark.read.parquet(f"{d}/boot/replicates").select("rep").distinct().count() == 5
    cli.main(["plot_h2", "--data", f"{d}/boot"])


def test_tools(spark, files):
    d, _ = files
    cli.main(["setup_regions", "--chrom", "1", "--centromere", "1500", "--end", "4000", "--size", "1000", "--out", f"{d}/tiles"])
    tiles = sorted(tuple(map(int, r.value.split("\t"))) for r in spark.read.text(f"{d}/tiles").collect())
    assert tiles == [(0, 1000, 1500), (1000, 1500, 1500), (1500, 2500, 4000), (2500, 3500, 4000), (3500, 4000, 4000)]
    cli.main(["parse_mut_vcf", "--input", f"{d}/v.vcf.gz", "--out", f"{d}/rates", "--bed", f"{d}/rates_bed"])
    assert spark.read.parquet(f"{d}/rates").count() == 60
    cli.main(["parse_vcf_coverage", "--vcf", f"{d}/v.vcf.gz", "--out", f"{d}/coverage"])
    assert spark.read.csv(f"{d}/coverage", sep="\t").count() == spark.read.csv(f"{d}/rates_bed", sep="\t").count()


GRAPH = """
time_units: generations
demes:
- {name: root, epochs: [{end_time: 3000, start_size: 9000}]}
- {name: X, ancestors: [root], epochs: [{end_time: 0, start_size: 4000}]}
- {name: Y, ancestors: [root], epochs: [{end_time: 0, start_size: 15000}]}
"""
PARAMETERS = """
parameters:
- {name: NX, lower_bound: 500, upper_bound: 40000, values: [demes: {X: {epochs: {0: start_size}}}]}
- {name: NY, lower_bound: 500, upper_bound: 90000, values: [demes: {Y: {epochs: {0: start_size}}}]}
"""


@pytest.fixture
def fitted(spark, tmp_path):
    """Means that a known graph expects, with errors of a twentieth, and replicates around them."""
    edges, u = [1e-6, 1e-5, 1e-4, 1e-3], 1.2e-8
    mu = ancestry.expected(graph.read_graph(GRAPH), ["X", "Y"], u, edges)
    rows = [(k if k < len(edges) - 1 else -1, s, float(mu[k, s])) for k in range(len(edges)) for s in range(3)]
    spark.createDataFrame(rows, "row long, stat_ord long, mean double").write.parquet(f"{tmp_path}/data/means")
    covs = [(r, s, t, (0.05 * m) ** 2 if s == t else 0.0) for r, s, m in rows for t in range(3)]
    spark.createDataFrame(covs, "row long, stat_i long, stat_j long, cov double").write.parquet(f"{tmp_path}/data/covs")
    rng = random.Random(1)
    reps = [(n, r, s, m * (1 + 0.05 * rng.gauss(0, 1))) for n in range(12) for r, s, m in rows]
    spark.createDataFrame(reps, "rep long, row long, stat_ord long, value double").write.parquet(f"{tmp_path}/data/replicates")
    (tmp_path / "bins").write_text(" ".join(map(str, edges)))
    (tmp_path / "params").write_text(PARAMETERS)
    (tmp_path / "start").write_text(GRAPH.replace("start_size: 4000", "start_size: 6000").replace("15000", "11000"))
    return tmp_path, u


def test_fit_uncertainties_and_parameter_tables(spark, fitted):
    d, u = fitted
    common = ["--data", f"{d}/data", "--params", f"{d}/params", "--bins", f"{d}/bins", "--u", str(u), "--include_h", "1"]
    for seed in (0, 1):
        cli.main(["fit_h2", *common, "--graph", f"{d}/start", "--out", f"{d}/fit{seed}.yaml", "--starts", "2", "--max_iter", "60", "--seed", str(seed)])
    g, p = graph.read_graph((d / "fit0.yaml").read_text()), graph.read_parameters(PARAMETERS)
    assert graph.get_values(g, p) == pytest.approx([4000, 15000], rel=0.05)
    assert g["metadata"]["opt_info"]["u"] == u
    for method in ("FIM", "GIM"):
        cli.main(["compute_uncerts", *common, "--graph", f"{d}/fit0.yaml", "--out", f"{d}/{method}", "--uncert_method", method])
        rows = {r.name: r for r in spark.read.parquet(f"{d}/{method}").collect()}
        assert set(rows) == {"NX", "NY"} and all(0 < r.se < r.value and r.low < r.value < r.high for r in rows.values())
    cli.main(["plot_params", "--params", f"{d}/params", "--graphs", f"{d}/fit0.yaml", f"{d}/fit1.yaml", "--out", f"{d}/table"])
    assert spark.read.parquet(f"{d}/table/fits").count() == 2
    assert spark.read.parquet(f"{d}/table/correlations").count() == 1
    assert spark.read.parquet(f"{d}/table/pairs").count() == 2


def test_a_fitted_rate(spark, fitted):
    d, u = fitted
    cli.main(["fit_h2", "--data", f"{d}/data", "--params", f"{d}/params", "--bins", f"{d}/bins", "--graph", f"{d}/start", "--out", f"{d}/fit.yaml", "--include_h", "1", "--starts", "1", "--max_iter", "80"])
    found = graph.read_graph((d / "fit.yaml").read_text())["metadata"]["opt_info"]["u"]
    assert 1e-8 <= found <= 1.6e-8 and found == pytest.approx(u, rel=0.1)


def test_windows_reach_to_their_right_ends(spark, files):
    """Some tiles only, two arms, and overlapping windows: all pairs up to r_end, and no others."""
    d, _ = files
    windows = [(0, 300, 1800), (200, 500, 1800), (1800, 2100, 4000), (2050, 2300, 3000), (200, 900, 1000)]
    (d / "some").write_text("\n".join(" ".join(map(str, w)) for w in windows))
    (d / "bp").write_text("0 10 300 2500")
    cli.main(["parse_h2", "--vcf", f"{d}/v.vcf.gz", "--bed", f"{d}/m.bed", "--regions", f"{d}/some", "--bins", f"{d}/bp", "--chrom", "1", "--out", f"{d}/some_stats"])
    rows = spark.read.parquet(f"{d}/some_stats").collect()
    lines = gzip.decompress((d / "v.vcf.gz").read_bytes()).decode().splitlines()[3:]
    het = {int(f[1]) - 1: f[9] in ("0/1", "1/0") for f in (line.split("\t") for line in lines)}
    covered = [p for p in range(4000) if p < 1500 or p >= 2000]
    edges = [0, 10, 300, 2500]
    for n, (start, l_end, r_end) in enumerate(windows):
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            pairs = [(p, q) for p in covered if start <= p < l_end for q in range(p + max(lo, 1), min(p + hi, r_end)) if q < 1500 or q >= 2000]
            (found,) = [r for r in rows if r.region == f"1_{n}" and r.row == k and r.stat_ord == 0]
            assert found.denom == len(pairs) and found.num == sum(het.get(p, False) and het.get(q, False) for p, q in pairs)
            assert (found.pop_i, found.low, found.high) == ("A", lo, hi)
        (found,) = [r for r in rows if r.region == f"1_{n}" and r.row == -1 and r.stat_ord == 0]
        assert found.denom == sum(start <= p < l_end for p in covered)
    cli.main(["bootstrap_h2", "--inputs", f"{d}/some_stats", "--out", f"{d}/some_boot"])
    cli.main(["plot_h2", "--data", f"{d}/some_boot", "--out", f"{d}/curves"])
    assert spark.read.parquet(f"{d}/curves").count() == 4 * 3
    cli.main(["plot_h2", "--data", f"{d}/some_boot", "--pops", "B", "--out", f"{d}/of_b"])
    want = {r.row: r["mean"] for r in spark.read.parquet(f"{d}/curves").where("stat_ord = 2").collect()}
    assert {r.row: r["mean"] for r in spark.read.parquet(f"{d}/of_b").collect()} == want
    assert spark.read.parquet(f"{d}/of_b_ratios").count() == 3
    (d / "g.yaml").write_text(GRAPH.replace("name: X", "name: A"))
    cli.main(["plot_h2", "--data", f"{d}/some_boot", "--graph", f"{d}/g.yaml", "--max_r", "300", "--out", f"{d}/of_a"])
    want = {r.row: r["mean"] for r in spark.read.parquet(f"{d}/curves").where("stat_ord = 0 and row < 2").collect()}
    assert {r.row: r["mean"] for r in spark.read.parquet(f"{d}/of_a").collect()} == want
    cli.main(["plot_h2", "--data", f"{d}/some_boot", f"{d}/some_boot", "--labels", "a", "b", "--graph", f"{d}/g.yaml", "--out", f"{d}/twice"])
    twice = spark.read.parquet(f"{d}/twice").collect()
    assert {(r.label, r.statistic) for r in twice} == {("a", "A"), ("b", "A")} and len(twice) == 2 * 4
    with pytest.raises(ValueError, match="label"):
        cli.main(["plot_h2", "--data", f"{d}/some_boot", f"{d}/some_boot"])
    both = Statistics.read(spark, f"{d}/some_boot")
    assert both.populations == ("A", "B") and both.edges == (0, 10, 300, 2500) and "A, B in 3 bins" in repr(both)
    turned = both.subset(["B", "A"])
    assert {(r.row, r.stat_ord): r["mean"] for r in turned.means.collect()} == {(r.row, 2 - r.stat_ord): r["mean"] for r in both.means.collect()}
    assert {(r.row, r.stat_i, r.stat_j): r["cov"] for r in turned.covs.collect()} == {(r.row, 2 - r.stat_i, 2 - r.stat_j): r["cov"] for r in both.covs.collect()}
    with pytest.raises(ValueError, match="doesn't have"):
        both.subset(["C"])


def test_empty_windows_rates_and_options(spark, files):
    """Windows that nothing covers have rows; rates go from one command to the other; chromosomes are told apart."""
    d, _ = files
    (d / "windows").write_text("0 1000 4000\n1500 2000 4000\n2000 4000 4000")
    (d / "bp").write_text("0 10 300")
    (d / "rates").write_text("chrom,start,end,u\nchr1,0,3000,2.0\nchr1,3000,4000,4.0\nchr2,0,4000,9.0\n")
    (d / "two.vcf").write_text(gzip.decompress((d / "v.vcf.gz").read_bytes()).decode() + "\n2\t500\t.\tA\tC\t.\t.\tMR=1.0\tGT\t0/1\t0/1")
    (d / "two.bed").write_text("chr1\t0\t1500\nchr1\t2000\t4000\nchr2\t0\t4000\n")
    common = ["--vcf", f"{d}/two.vcf", "--bed", f"{d}/two.bed", "--regions", f"{d}/windows", "--bins", f"{d}/bp"]
    cli.main(["parse_h2", *common, "--chrom", "1", "--mut_map", f"{d}/rates", "--out", f"{d}/weighted"])
    rows = {(r.region, r.row, r.stat_ord): r for r in spark.read.parquet(f"{d}/weighted").collect()}
    assert len(rows) == 3 * 3 * 3 and all((rows["1_1", k, 0].num, rows["1_1", k, 0].denom) == (0, 0) for k in (-1, 0, 1))
    assert rows["1_0", -1, 0].denom == 1000  # of chromosome 1 only
    rates = {r.region: (r.num_sites, r.mean_mut) for r in spark.read.parquet(f"{d}/weighted_rates").collect()}
    assert rates == {"1_0": (1000, 2.0), "1_1": (0, None), "1_2": (2000, 3.0)}
    cli.main(["bootstrap_h2", "--inputs", f"{d}/weighted", "--rates", f"{d}/weighted_rates", "--out", f"{d}/weighted_boot"])
    means = {(r.row, r.stat_ord): r["mean"] for r in spark.read.parquet(f"{d}/weighted_boot/means").collect()}
    factor = ((1000 * 2 + 2000 * 3) / 3000) ** 2
    for k in (0, 1):
        own = [rows[w, k, 0] for w in ("1_0", "1_1", "1_2")]
        assert means[k, 0] == pytest.approx(sum(r.num for r in own) / (sum(r.denom for r in own) / factor))
    with pytest.raises(ValueError, match="none of chromosome"):
        cli.main(["parse_h2", *common, "--chrom", "3", "--out", f"{d}/none"])
    # Sites as denominators, one-sample statistics; such tables and the others don't go together.
    cli.main(["parse_h2", *common, "--chrom", "1", "--compute_denom", "0", "--compute_two_sample", "0", "--out", f"{d}/sites"])
    got = spark.read.parquet(f"{d}/sites")
    assert {r.stat_ord for r in got.collect()} == {0, 1}
    assert got.where("row = -1 and stat_ord = 0").groupBy().sum("denom").first()[0] == len([p for p in files[1] if p < 1000 or p >= 1500])
    cli.main(["parse_h2", *common, "--chrom", "1", "--compute_denom", "0", "--compute_snp_denom", "0", "--out", f"{d}/sums"])
    assert spark.read.parquet(f"{d}/sums").where("denom is not null").count() == 0
    with pytest.raises(ValueError, match="different"):
        cli.main(["bootstrap_h2", "--inputs", f"{d}/weighted", f"{d}/sites", "--out", f"{d}/bad"])


def test_whole_chromosome_constant_rate_and_units(spark, files):
    """Without regions the chromosome is one; a constant rate is a map; bins may be map distances."""
    d, _ = files
    (d / "cm").write_text("0 0.01 0.05")
    common = ["--vcf", f"{d}/v.vcf.gz", "--bed", f"{d}/m.bed", "--chrom", "1"]
    cli.main(["parse_h2", *common, "--bins", f"{d}/cm", "--bin_unit", "cM", "--rec_map", f"{d}/map", "--out", f"{d}/by_map"])
    (d / "bp").write_text("0 100 500")
    cli.main(["parse_h2", *common, "--bins", f"{d}/bp", "--out", f"{d}/by_bp"])
    # One base pair is 1e-4 cM: bins of 0.01 cM are those of 100 base pairs.
    rows = [{(r.region, r.row, r.stat_ord): (r.num, r.denom) for r in spark.read.parquet(f"{d}/{x}").collect()} for x in ("by_map", "by_bp")]
    assert rows[0].keys() == rows[1].keys() and {k[0] for k in rows[0]} == {"1_0"}
    assert all(rows[0][k][1] == pytest.approx(rows[1][k][1], rel=0.01) for k in rows[0])
    r = 1e-6
    (d / "r").write_text(f"0 {0.5 * (1 - (1 - 2 * r) ** 100.5)} {0.5 * (1 - (1 - 2 * r) ** 500.5)}")
    (d / "half").write_text("0 100.5 500.5")
    cli.main(["parse_h2", *common, "--bins", f"{d}/r", "--r", str(r), "--out", f"{d}/by_rate"])
    cli.main(["parse_h2", *common, "--bins", f"{d}/half", "--out", f"{d}/by_half"])
    rows = [{(r.region, r.row, r.stat_ord): (r.num, r.denom) for r in spark.read.parquet(f"{d}/{x}").collect()} for x in ("by_rate", "by_half")]
    assert rows[0] == rows[1]
    with pytest.raises(ValueError, match="map"):
        cli.main(["parse_h2", *common, "--bins", f"{d}/bp", "--bin_unit", "r", "--out", f"{d}/none"])


def test_dense_rates_and_steps_agree(spark, files):
    """A dense array goes by position, steps by interval: the same denominators."""
    d, _ = files
    (d / "w").write_text("0 1000 3000\n500 2500 4000")
    (d / "steps").write_text("chrom,start,end,u\n1,0,800,2.0\n1,900,2600,0.5\n")
    spark.createDataFrame([(p, 2.0 if p < 800 else 0.5) for p in [*range(800), *range(900, 2600)]], "pos long, u double").write.parquet(f"{d}/dense.parquet")
    common = ["--vcf", f"{d}/v.vcf.gz", "--bed", f"{d}/m.bed", "--chrom", "1", "--bins", f"{d}/bins", "--rec_map", f"{d}/map", "--regions", f"{d}/w"]
    found = []
    for x in ("steps", "dense.parquet"):
        cli.main(["parse_h2", *common, "--mut_map", f"{d}/{x}", "--out", f"{d}/out_{x}"])
        found.append({(r.region, r.row, r.stat_ord): (r.num, r.denom) for r in spark.read.parquet(f"{d}/out_{x}").collect()})
        rates = {r.region: (r.num_sites, r.mean_mut) for r in spark.read.parquet(f"{d}/out_{x}_rates").collect()}
        assert rates["1_0"] == (900, pytest.approx((800 * 2 + 100 * 0.5) / 900))
    assert found[0].keys() == found[1].keys()
    assert all(found[0][k] == pytest.approx(found[1][k], rel=1e-3) for k in found[0])


def test_dense_mutation_rates(spark, tmp_path):
    from pairlocus.sources import bed

    rows = [(0, 1.0), (1, float("nan")), (2, None), (3, 2.0)]
    spark.createDataFrame(rows, "pos long, u double").write.parquet(f"{tmp_path}/dense.parquet")
    got = bed.read_mutation_map(spark, f"{tmp_path}/dense.parquet", "5").collect()
    assert sorted(tuple(r) for r in got) == [("5", 0, 1, 1.0), ("5", 3, 4, 2.0)]
