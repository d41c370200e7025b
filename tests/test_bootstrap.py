import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlocus.operators import bootstrap, likelihood, quadrature, views

STATS = "region string, row long, stat_ord long, num double, denom double"


@pytest.fixture
def stats(spark):
    rng = np.random.default_rng(2)
    rows = [(f"r{r}", row, s, float(rng.integers(1, 9)), float(rng.integers(5, 9))) for r in range(6) for row in (-1, 0, 1) for s in (0, 1)]
    return spark.createDataFrame(rows, STATS), rows


def test_replicates_keep_repeated_draws(spark, stats):
    df, rows = stats
    regions = sorted({r[0] for r in rows})
    drawn = {}
    for r in bootstrap.draws(bootstrap.numbered(df), 4, 9, seed=3).collect():
        drawn.setdefault(r.rep, []).append(regions[r.region_ord])
    assert all(len(d) == 9 for d in drawn.values())  # of six regions: some are drawn again
    got = {(r.rep, r.row, r.stat_ord): r.value for r in bootstrap.replicates(df, 4, 9, seed=3).collect()}
    for rep, names in drawn.items():
        for row in (-1, 0, 1):
            for s in (0, 1):
                picked = [x for n in names for x in rows if x[:3] == (n, row, s)]
                assert got[(rep, row, s)] == pytest.approx(sum(x[3] for x in picked) / sum(x[4] for x in picked))
    cov = {(r.row, r.stat_i, r.stat_j): r.cov for r in bootstrap.covariances(bootstrap.replicates(df, 4, 9, seed=3)).collect()}
    a, b = ([got[(rep, 0, s)] for rep in range(4)] for s in (0, 1))
    assert cov[(0, 0, 1)] == pytest.approx(np.cov(a, b)[0, 1])


def test_as_many_draws_as_regions_by_default(stats):
    df, _ = stats
    assert bootstrap.replicates(df).select("rep").distinct().count() == 6


def test_rates_scale_pairs_only(spark, stats):
    df, rows = stats
    rates = spark.createDataFrame([(f"r{n}", 10 + n, 2.0) for n in range(6)], "region string, num_sites long, mean_mut double")
    plain = {(r.row, r.stat_ord): r["mean"] for r in bootstrap.region_means(df).collect()}
    by_rate = {(r.row, r.stat_ord): r["mean"] for r in bootstrap.region_means(df, rates).collect()}
    by_target = {(r.row, r.stat_ord): r["mean"] for r in bootstrap.region_means(df, rates, target=3.0).collect()}
    for (row, s), value in plain.items():
        assert by_rate[(row, s)] == pytest.approx(value * (1 if row == -1 else 4))
        assert by_target[(row, s)] == pytest.approx(value * (1 if row == -1 else 9))


def test_repeated_regions_fail(stats):
    df, rows = stats
    assert bootstrap.combine(df).count() == len(rows)
    with pytest.raises(Exception, match="two tables"):
        bootstrap.combine(df, df.where("region = 'r1'")).collect()


def test_subsets_and_denominators(spark, stats):
    df, _ = stats
    one = bootstrap.subset_statistics(df, [1]).collect()
    assert {r.stat_ord for r in one} == {0} and len(one) == 18
    kept = bootstrap.subset_bins(df, [1e-4, 1e-3, 1e-2], 5e-4, 1e-2)
    assert {r.row for r in kept.select("row").collect()} == {-1, 1}
    denoms = spark.createDataFrame([("r0", 0, 2.0)], "region string, row long, denom double")
    new = bootstrap.replace_denominators(df, denoms).where("region = 'r0' and row = 0").collect()
    assert {r.denom for r in new} == {2.0}


@pytest.mark.parametrize(("size", "rank"), [(1, 1), (2, 2), (10, 10), (10, 4), (70, 70)])
def test_precisions_of_any_size(spark, size, rank):
    rng = np.random.default_rng(size + rank)
    covs = {}
    for row in (-1, 0):
        a = rng.normal(size=(size, rank)) * 10.0 ** rng.integers(-3, 4, size)[:, None]
        covs[row] = a @ a.T
    long = [(r, i, j, float(c[i, j])) for r, c in covs.items() for i in range(size) for j in range(size)]
    rows = likelihood.precisions(spark.createDataFrame(long, "row long, stat_i int, stat_j int, cov double")).collect()
    got = {r: np.zeros((size, size)) for r in covs}
    for r in rows:
        got[r.row][r.stat_i, r.stat_j] = r.value
    for r, c in covs.items():
        if rank == size:
            assert got[r] @ c == pytest.approx(np.eye(size), abs=1e-4)
        else:
            assert c @ got[r] @ c == pytest.approx(c, rel=1e-3, abs=1e-6 * abs(c).max())
    data = spark.createDataFrame([(r, s, 1.0 + s) for r in covs for s in range(size)], "row long, stat_ord int, mean double")
    bins = likelihood.bin_likelihoods(data, data.withColumn("mean", F.lit(0.5)), spark.createDataFrame(long, "row long, stat_i int, stat_j int, cov double"))
    found = {r.row: r.ll for r in bins.collect()}
    dx = np.arange(size) + 0.5
    assert all(found[r] == pytest.approx(-dx @ got[r] @ dx, rel=1e-6) for r in covs)
    assert likelihood.total_likelihood(bins).first().ll == pytest.approx(found[0])
    assert likelihood.total_likelihood(bins, True).first().ll == pytest.approx(found[0] + found[-1])


def test_quadratic_forms_and_inverse(spark):
    cov = np.array([[2.0, 0.5], [0.5, 1.0]])
    long = spark.createDataFrame([(0, i, j, float(cov[i, j])) for i in (0, 1) for j in (0, 1)], "row long, stat_i int, stat_j int, cov double")
    data = spark.createDataFrame([(0, 0, 3.0), (0, 1, 1.0)], "row long, stat_ord int, mean double")
    model = spark.createDataFrame([(0, 0, 2.0), (0, 1, 3.0)], "row long, stat_ord int, mean double")
    ll = likelihood.quadratic_forms(data, model, likelihood.precisions(long)).first().ll
    dx = np.array([1.0, -2.0])
    assert ll == pytest.approx(-dx @ np.linalg.inv(cov) @ dx)


def test_quadrature_is_exact_for_parabolas(spark):
    edges = [0.0, 1.0, 3.0, 4.0]
    values = spark.createDataFrame([("a", n, x * x) for n, x in enumerate(quadrature.points(edges, "simpson"))], "k string, point int, value double")
    got = sorted((r.bin_id, r.value) for r in quadrature.integrate(values, "simpson", ["k"]).collect())
    want = [(b**3 - a**3) / 3 / (b - a) for a, b in zip(edges, edges[1:], strict=False)]
    assert [v for _, v in got] == pytest.approx(want)
    with pytest.raises(ValueError, match="rule"):
        quadrature.points(edges, "other")


def test_views(spark):
    df = spark.createDataFrame([(float(x), float(x * x % 7), 1.0) for x in range(12)], "a double, b double, ll double")
    rho = views.parameter_correlations(df, ["a", "b"], least=0.0).first()
    x = np.arange(12.0)
    assert rho.rho == pytest.approx(np.corrcoef(x, x * x % 7)[0, 1])
    edges = [0, 4, 8, 11]
    counts, _ = np.histogram(x, edges)
    got = {r.bin_id: r.n for r in views.histogram(df, "a", edges).collect()}
    assert got == dict(enumerate(counts))
    q = views.quartiles(df.withColumn("k", F.lit(1)), ["k"], "a").first()
    assert (q.q1, q.median, q.q3) == tuple(np.percentile(x, [25, 50, 75]))
    arms = spark.createDataFrame([(1, "l", 0.5), (1, "r", 0.25)], "chrom long, arm string, mean double")
    assert views.cross_product(arms, ["chrom"], "l", "r").first()["cross"] == 0.125


@pytest.mark.parametrize("n", [20, 100])
def test_draws_give_the_variance_of_a_mean(spark, n):
    values = np.arange(n) + np.random.default_rng(4).normal(0, n / 10, n)
    df = spark.createDataFrame([(f"r{i:03d}", 0, 0, float(v), 1.0) for i, v in enumerate(values)], STATS)
    means = [r.value for r in bootstrap.replicates(df, 600, n, seed=1).collect()]
    assert np.var(means) == pytest.approx(values.var() / n, rel=0.25)
    drawn = [len({r.region_ord for r in bootstrap.draws(bootstrap.numbered(df), 40, n).collect() if r.rep == k}) for k in range(3)]
    assert all(d < n for d in drawn)
