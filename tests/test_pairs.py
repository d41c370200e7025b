import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairlocus.operators import hstats, pairs

EDGES = [0, 10, 32, 100]
METHODS = ["ranks", "halo", "join"]


def brute(sites, edges, left=None):
    """{(chrom, bin): sum of v_i v_j} of (chrom, pos, at, v), by all pairs."""
    out = Counter()
    for chrom, pos, at, v in sites:
        if left is not None and pos >= left:
            continue
        for k in range(len(edges) - 1):
            out[(chrom, k)] += 0
        for chrom2, pos2, at2, v2 in sites:
            if chrom2 == chrom and pos2 > pos:
                for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                    if at + lo <= at2 < at + hi:
                        out[(chrom, k)] += v * v2
    return dict(out)


def table(spark, sites, kind="long"):
    return spark.createDataFrame(sites, f"chrom long, pos long, at {kind}, v long")


def found(df):
    return {(r.chrom, r.bin_id): r.total for r in df.collect()}


@pytest.mark.parametrize("method", METHODS)
def test_equal_positions_exact_edges_and_empty_bins(spark, method):
    sites = [(1, 1, 5, 1), (1, 2, 5, 2), (1, 3, 15, 3), (1, 4, 37, 1), (1, 9, 500, 1), (2, 1, 0, 4)]
    got = pairs.pair_sums(table(spark, sites), EDGES, ["chrom"], "at", value="v", method=method)
    assert found(got) == brute(sites, EDGES)


@pytest.mark.parametrize("method", METHODS)
def test_left_limit_of_no_and_of_some_sites(spark, method):
    sites = [(1, p, p, 1) for p in (0, 4, 9, 20, 33)]
    df = table(spark, sites)
    some = pairs.pair_sums(df.withColumn("l", F.col("pos") < 9), EDGES, ["chrom"], "at", left="l", method=method)
    assert found(some) == brute(sites, EDGES, left=9)
    none = pairs.pair_sums(df.withColumn("l", F.lit(False)), EDGES, ["chrom"], "at", left="l", method=method)
    assert found(none) == {}


@pytest.mark.parametrize("method", METHODS)
def test_many_buckets(spark, method):
    rng = random.Random(4)
    sites = [(c, p, p, rng.randint(0, 3)) for c in (0, 1) for p in sorted(rng.sample(range(2000), 120))]
    got = pairs.pair_sums(table(spark, sites), EDGES, ["chrom"], "at", value="v", method=method)
    assert found(got) == brute([s for s in sites if s[3]], EDGES)


@pytest.mark.parametrize("method", METHODS)
def test_no_sites(spark, method):
    assert pairs.pair_sums(table(spark, []), EDGES, ["chrom"], "at", method=method).count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 60), min_size=1, max_size=25), st.sampled_from(["ranks", "halo"]))
def test_any_positions(spark, steps, method):
    at, sites = 0, []
    for n, step in enumerate(steps):
        at += step // 3
        sites.append((0, n, at, 1))
    got = pairs.pair_sums(table(spark, sites), EDGES, ["chrom"], "at", method=method)
    assert found(got) == brute(sites, EDGES)


def test_mean_of_products_in_one_pass(spark):
    values = [0.5, 1.5, 2.0, 4.0]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 3.0)], "chrom long, u double")
    rows = {r.chrom: r for r in pairs.mean_product(df, ["chrom"], "u").collect()}
    products = [a * b for i, a in enumerate(values) for b in values[i + 1 :]]
    assert rows[1].mean_mut_prod == pytest.approx(sum(products) / len(products))
    assert rows[2].mean_mut_prod is None and rows[2].num_sites == 1


GENOTYPES = "chrom long, pos long, gt array<struct<a0: int, a1: int>>"


def test_heterozygosity_of_one_and_two_samples(spark):
    sites = [(1, 0, [(0, 1), (0, 0)]), (1, 5, [(0, 1), (1, 1)]), (1, 40, [(2, 2), (0, 1)])]
    df = spark.createDataFrame(sites, GENOTYPES)
    h = {r.stat_ord: r.num for r in hstats.one_locus(df, 2, ["chrom"]).collect()}
    assert h == {0: 2.0, 1: 2 * 0.5 + 1.0, 2: 1.0}
    h2 = {(r.stat_ord, r.bin_id): r.num for r in hstats.two_locus(df, 2, EDGES, ["chrom"]).collect()}
    assert h2[(0, 0)] == 1.0 and h2[(0, 1)] == 0.0
    assert h2[(1, 0)] == 0.25 and h2[(1, 2)] == 0.5 + 0.5


def test_phased_statistics_are_refused(spark):
    df = spark.createDataFrame([], GENOTYPES)
    with pytest.raises(NotImplementedError):
        hstats.two_locus(df, 2, EDGES, ["chrom"], phased=True)


def test_populations_are_selected_and_ordered(spark):
    df = spark.createDataFrame([(1, 0, [(0, 0), (0, 1), (1, 1)])], GENOTYPES)
    kept = hstats.select_populations(df, ["a", "b", "c"], [("c", "X"), ("a", "Y")]).first()
    assert [(g.a0, g.a1) for g in kept.gt] == [(1, 1), (0, 0)]
    with pytest.raises(ValueError, match="don't have"):
        hstats.select_populations(df, ["a"], [("z", "X")])
    with pytest.raises(ValueError, match="unique"):
        hstats.select_populations(df, ["a", "b"], [("a", "X"), ("b", "X")])


def test_region_rows_and_zero_denominators(spark):
    sites = spark.createDataFrame([(1, 0, [(0, 1)], "r0", 2), (1, 5, [(0, 1)], "r0", 3), (1, 9, [(0, 1)], "r1", 1)], GENOTYPES + ", region string, u long")
    rows = {(r.region, r.bin_id): r for r in hstats.region_statistics(sites, sites, 1, EDGES, "pos", "u").collect()}
    assert rows[("r0", 0)].num == 3.0 and rows[("r0", 0)].denom == 2 * 3 + 2 * 1 + 3 * 1
    assert rows[("r1", 0)].num == 0.0 and rows[("r1", 0)].denom == 0.0
    assert rows[("r0", -1)].num == 2.0 and rows[("r0", -1)].denom == 2.0
    means = hstats.means(
        spark.createDataFrame([(0, 1.0), (1, 1.0)], "bin_id int, num double"), spark.createDataFrame([(0, 0.0)], "bin_id int, denom double"), ["bin_id"]
    )
    assert [r["mean"] for r in means.collect()] == [None, None]


def test_several_values_in_one_pass(spark):
    """A row for each value, in every plan; more left sites than a slice; groups of left sites that alternate."""
    rng = random.Random(11)
    sites = [(c, p, p, rng.randint(0, 2), rng.randint(0, 1), f"g{p % 3}") for c in (0, 1) for p in sorted(rng.sample(range(600), 200))]
    df = spark.createDataFrame(sites, "chrom long, pos long, at long, v long, w long, g string")
    want = Counter()
    for c, p, _, *own, g in sites:
        for c2, q, _, *other, _ in sites:
            for k, (lo, hi) in enumerate(zip(EDGES, EDGES[1:])):
                if c == c2 and q > p and p + lo <= q < p + hi:
                    for n in (0, 1):
                        want[c, g, n, k] += own[n] * other[n]
    for method in METHODS:
        got = pairs.pair_sums(df, EDGES, ["chrom"], "at", value=["v", "w"], left_by=["g"], method=method)
        assert {(r.chrom, r.g, r.stat_ord, r.bin_id): r.total for r in got.collect() if r.total} == {k: v for k, v in want.items() if v}


def test_slices_of_left_sites(monkeypatch):
    rng = np.random.default_rng(2)
    at, v = np.sort(rng.integers(0, 500, 300)).astype(float), rng.integers(0, 4, (300, 2))
    first, codes = np.arange(300), rng.integers(0, 3, 300)
    whole = pairs.binned_sums(at, v, first, codes, np.array(EDGES, float))
    monkeypatch.setattr(pairs, "SLICE", 7)
    assert (pairs.binned_sums(at, v, first, codes, np.array(EDGES, float)) == whole).all()


@pytest.mark.parametrize("width", [7, 64, 1 << 20])
def test_pairs_of_a_mask_from_its_intervals(spark, width):
    """Windows of two arms, overlapping, partly and not covered, against all positions one by one."""
    rng = random.Random(13)
    mask = [("1", a, a + rng.randint(1, 25)) for a in rng.sample(range(400), 25)] + [("2", 0, 50)]
    windows = [("1", "w0", 0, 100, 200), ("1", "w1", 100, 200, 200), ("1", "w2", 200, 260, 430), ("1", "w3", 230, 430, 430), ("1", "w4", 500, 600, 700), ("2", "w5", 10, 20, 30)]
    edges = [0, 2.5, 10, 30, 500]
    covered = {c: {p for d, a, b in mask if d == c for p in range(a, b)} for c in "12"}
    want = {}
    for c, name, start, l_end, r_end in windows:
        own = sorted(p for p in covered[c] if start <= p < l_end)
        if own:
            want[name, -1] = len(own)
            for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
                want[name, k] = sum(1 for p in own for q in covered[c] if p < q < r_end and p + lo <= q < p + hi)
    got = pairs.mask_pair_counts(
        spark.createDataFrame(mask, "chrom string, start long, end long"), spark.createDataFrame(windows, "chrom string, region string, start long, l_end long, r_end long"), edges, width
    )
    assert {(r.region, r.bin_id): r.denom for r in got.collect()} == want


def test_many_samples_equal_single_statistics(spark):
    """Statistics made from packed alleles, some missing, are those of all pairs of samples and sites."""
    import random

    from pairlocus.operators import hstats

    rng, samples = random.Random(8), 12
    rows = [(1 + n % 2, 7 * n + rng.randint(0, 5), [(rng.choice([None, 0, 1, 2]), rng.choice([0, 1])) for _ in range(samples)]) for n in range(60)]
    sites = spark.createDataFrame(rows, "chrom int, pos long, gt array<struct<a0: int, a1: int>>")

    def d(a, b, same):
        if None in (*a, *b):
            return 0
        return 4 * (a[0] != a[1]) if same else sum(x != y for x in a for y in b)

    edges, want, ones = [0, 20, 100], {}, {}
    for n, i, j in hstats.triangle(samples):
        value = {(c, p): d(gt[i], gt[j], i == j) for c, p, gt in rows}
        for c in (1, 2):
            ones[c, n] = sum(v for (x, _), v in value.items() if x == c) / 4
            for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                want[c, n, k] = sum(v * w for (x, p), v in value.items() for (y, q), w in value.items() if x == y == c and p < q and lo <= q - p < hi) / 16
    got = {(r.chrom, r.stat_ord, r.bin_id): r.num for r in hstats.two_locus(sites, samples, edges, ["chrom"]).collect()}
    assert got == want
    assert {(r.chrom, r.stat_ord): r.num for r in hstats.one_locus(sites, samples, ["chrom"]).collect()} == ones


def test_join_compares_only_sites_of_near_buckets(spark):
    """In one large group the band join meets neighbours, not all pairs: the bucket is one of its keys."""
    sites = spark.range(3000).select(F.lit(1).cast("long").alias("chrom"), (F.col("id") * 40).alias("pos"))
    got = pairs.pair_sums(sites, EDGES, ["chrom"], "pos", method="join")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert any("Join" in line and "bucket" in line for line in plan.splitlines())
    assert found(got) == {(1, 0): 0, (1, 1): 0, (1, 2): 2999 + 2998}


@pytest.mark.parametrize("edges", [[5, 20, 20, 60], [0.5, 3.0, 41.0]])
@pytest.mark.parametrize("method", METHODS)
def test_first_edges_above_zero_and_bins_without_width(spark, method, edges):
    rng = random.Random(6)
    at, sites = 0, []
    for n in range(80):
        at += rng.randint(0, 9)
        sites.append((n % 2, n, at, 1 + n % 3))
    got = pairs.pair_sums(table(spark, sites), edges, ["chrom"], "at", value="v", method=method)
    assert found(got) == brute(sites, edges)
