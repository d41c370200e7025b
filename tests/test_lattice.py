"""Pairs on intervals under maps and rates, against all pairs of positions."""

import random
from fractions import Fraction

import pytest

from pairlocus.operators import lattice


def test_floor_sum():
    rng = random.Random(1)
    for _ in range(2000):
        n, m, a, b = rng.randint(0, 30), rng.randint(1, 40), rng.randint(-90, 90), rng.randint(-90, 90)
        assert lattice.floor_sum(n, m, a, b) == sum((a * i + b) // m for i in range(n))


def value(knots, x):
    """The map's exact value at a position."""
    if knots is None:
        return Fraction(x)
    knots = sorted(knots)
    if x < knots[0][0]:
        return Fraction(knots[0][1])
    for (p0, v0), (p1, v1) in zip(knots, knots[1:], strict=False):
        if p0 <= x < p1:
            p0, v0, p1, v1 = map(Fraction, (p0, v0, p1, v1))
            return v0 + (v1 - v0) * (x - p0) / (p1 - p0)
    return Fraction(knots[-1][1])


def brute(runs, windows, edges, knots):
    at = [(x, u) for s, e, u in runs for x in range(s, e)]
    out = {}
    for name, start, l_end, r_end in windows:
        firsts = [(x, u) for x, u in at if start <= x < min(l_end, r_end)]
        if not firsts:
            continue
        out[name, -1] = len(firsts)
        g = {x: value(knots, x) for x, _ in at}
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            lo, hi = Fraction(lo), Fraction(hi)
            out[name, k] = sum(u * w for x, u in firsts for y, w in at if x < y < r_end and g[x] + lo <= g[y] < g[x] + hi)
    return out


def case(rng, mapped):
    runs, x = [], rng.randint(0, 5)
    while x < 70:
        stop = x + rng.randint(1, 15)
        runs.append((x, stop, rng.randint(1, 4)))
        x = stop + rng.choice([0, 0, 1, 6])
    windows = [("a", 0, 40, 60), ("b", 10, 30, 45), ("c", 0, 100, 100), ("a2", 0, 10, 10), ("none", 90, 95, 99)]
    knots = None
    if mapped:
        bps = sorted(rng.sample([Fraction(n, 2) for n in range(4, 150)], rng.randint(1, 8)))
        cms, v = [], 0.0
        for _ in bps:
            cms.append(v)
            v += rng.choice([0.0, 0.0, 0.1, 1 / 3, 0.5, 2.0])
        knots = [(float(b), c) for b, c in zip(bps, cms, strict=True)]
    edges = sorted(rng.choice([0.0, 0.0, 0.1, 1 / 3, 0.25, 1.0, 2.5, 7.0, 20.0]) for _ in range(5))
    return runs, windows, edges, knots


@pytest.mark.parametrize("mapped", [False, True])
def test_single_stretch_equals_all_pairs(mapped):
    rng = random.Random(7)
    for _ in range(300):
        runs, windows, edges, knots = case(rng, mapped)
        want = brute(runs, windows, edges, knots)
        segments = None if knots is None else [(*a, *b) for a, b in zip(sorted(knots), sorted(knots)[1:], strict=False)]
        lines, here = lattice.Lines(segments), lattice.Runs(*zip(*runs, strict=True))
        for name, start, l_end, r_end in windows:
            parts = [(max(s, start), min(e, l_end, r_end), u) for s, e, u in runs if max(s, start) < min(e, l_end, r_end)]
            up = [sum(u * lattice.reach_of(a, b, r_end, e, lines, here) for a, b, u in parts) for e in edges]
            for k in range(len(edges) - 1):
                assert up[k + 1] - up[k] == want.get((name, k), 0), (runs, edges, knots, name, k)


@pytest.mark.parametrize(("mapped", "width"), [(False, 16), (True, 16), (True, 7), (True, 1 << 20)])
def test_stretches_equal_all_pairs(spark, mapped, width):
    rng = random.Random(width)
    for _ in range(2):
        runs, windows, edges, knots = case(rng, mapped)
        got = lattice.interval_pair_sums(
            spark.createDataFrame([(c, *r) for c in (1, 2) for r in runs], "chrom int, start long, end long, u long"),
            spark.createDataFrame([(c, f"{c}{n}", s, e, r) for c in (1, 2) for n, s, e, r in windows], "chrom int, region string, start long, l_end long, r_end long"),
            edges,
            spark.createDataFrame([(c, *k) for c in (1, 2) for k in knots], "chrom int, bp double, cm double") if mapped else None,
            width,
        )
        want = brute(runs, windows, edges, knots)
        assert {(r.chrom, r.region, r.bin_id): r.denom for r in got.collect()} == {(c, f"{c}{n}", k): v for c in (1, 2) for (n, k), v in want.items()}


def test_rates_and_masks(spark):
    mask = spark.createDataFrame([(1, 0, 10), (1, 20, 40)], "chrom int, start long, end long")
    steps = spark.createDataFrame([(1, 0, 5, 0.5), (1, 8, 30, 0.25), (1, 35, 60, 2.0)], "chrom int, start long, end long, u double")
    runs = lattice.weighted_runs(mask, steps)
    rows = sorted((r.start, r.end, r.u) for r in runs.collect())
    assert rows == [(0, 5, 0.5), (8, 10, 0.25), (20, 30, 0.25), (35, 40, 2.0)]
    windows = spark.createDataFrame([(1, "w", 0, 25, 38), (1, "v", 50, 60, 70)], "chrom int, region string, start long, l_end long, r_end long")
    got = {(r.region, r.bin_id): r.denom for r in lattice.interval_pair_sums(runs, windows, [0, 4, 30]).collect()}
    want = brute(rows, [("w", 0, 25, 38)], [0, 4, 30], None)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(float(want[k])) for k in want)
    rates = {r.region: (r.num_sites, r.mean_mut) for r in lattice.interval_rates(runs, windows).collect()}
    assert rates == {"w": (12, pytest.approx((5 * 0.5 + 7 * 0.25) / 12)), "v": (0, None)}


def test_pieces_that_windows_share_are_summed_once(monkeypatch):
    """Right ends behind all that a piece reaches take one sum; nearer ones their own."""
    lines = lattice.Lines([(0, 0.0, 40, 2.0), (40, 2.0, 60, 2.0), (60, 2.0, 100, 5.0)])
    runs, calls, plain = lattice.Runs([0, 30, 70], [20, 60, 95], [1, 3, 2]), [], lattice.reach_of
    monkeypatch.setattr(lattice, "reach_of", lambda *x: calls.append(x) or plain(*x))
    for a, b in ((2, 9), (33, 50), (80, 95)):
        for edge in (Fraction(0), Fraction(1, 4), Fraction(1, 2), Fraction(9)):
            stops = [12, 100, 60, 90, 95, 100, 120]
            assert lattice.reaches_of(a, b, stops, edge, lines, runs) == [plain(a, b, stop, edge, lines, runs) for stop in stops]
    calls.clear()
    lattice.reaches_of(2, 9, [40, 60, 90], Fraction(1, 4), lines, runs)
    assert len(calls) == 1
