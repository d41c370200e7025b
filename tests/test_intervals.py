import random
import re

import numpy as np
import pytest

from pairlocus.operators import intervals, maps

SCHEMA = "chrom string, start long, end long"


def spans(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def covered(rows):
    return {p for _, a, b in rows for p in range(a, b)}


def runs_of(positions):
    out = []
    for p in sorted(positions):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(x) for x in out]


@pytest.fixture
def random_spans():
    rng = random.Random(2)

    def make(n):
        starts = [rng.randrange(300) for _ in range(n)]
        return [("1", a, a + rng.randint(0, 12)) for a in starts]

    return make


def test_merge_and_positions(spark, random_spans):
    rows = [*random_spans(40), ("1", 400, 410), ("1", 410, 420), ("1", 500, 500)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert spans(intervals.merge(df)) == runs_of(covered(rows))
    assert sorted(r.pos for r in intervals.positions(df, 50, 200).collect()) == sorted(p for p in covered(rows) if 50 <= p < 200)


def test_intersection_of_three(spark, random_spans):
    tables = [random_spans(30) for _ in range(3)]
    got = intervals.intersect(*[spark.createDataFrame(t, SCHEMA) for t in tables])
    assert spans(got) == runs_of(set.intersection(*map(covered, tables)))


def test_runs_of_repeated_positions(spark):
    df = spark.createDataFrame([("1", p) for p in (5, 3, 4, 4, 9, 10)], "chrom string, pos long")
    assert spans(intervals.runs(df)) == [(3, 6), (9, 11)]


@pytest.mark.parametrize("width", [4, 1 << 16])
def test_points_in_intervals(spark, random_spans, width):
    rows = random_spans(20)
    points = spark.createDataFrame([("1", p) for p in range(330)] + [("2", 5)], "chrom string, pos long")
    kept = intervals.in_mask(points, spark.createDataFrame(rows, SCHEMA), width)
    assert sorted((r.chrom, r.pos) for r in kept.collect()) == [("1", p) for p in sorted(covered(rows))]


def test_tiles(spark):
    whole = spark.createDataFrame([("1", 0, 25)], SCHEMA)
    rows = sorted((r.start, r.l_end, r.r_end) for r in intervals.segments(whole, 10).collect())
    assert rows == [(0, 10, 25), (10, 20, 25), (20, 25, 25)]
    arms = spark.createDataFrame([("1", 12, 25)], "chrom string, centromere long, end long")
    rows = sorted((r.start, r.l_end, r.r_end) for r in intervals.arm_segments(arms, 10).collect())
    assert rows == [(0, 10, 12), (10, 12, 12), (12, 22, 25), (22, 25, 25)]
    assert spans(intervals.plain_tiles(25, 10, spark)) == [(0, 10), (10, 20), (20, 30)]
    tiles = spans(intervals.random_tiles(1000, 50.0, spark))
    assert tiles[0][0] == 0 and tiles[-1][1] == 1000 and all(a[1] == b[0] for a, b in zip(tiles, tiles[1:], strict=False))


def test_arms_of_bands(spark):
    bands = [("chr1", 0, 40, "p1"), ("chr1", 40, 90, "q1"), ("chr13", 0, 10, "p1"), ("chr13", 10, 70, "q1")]
    got = intervals.chromosome_arms(spark.createDataFrame(bands, SCHEMA + ", band string"))
    assert sorted((r.chrom, r.start, r.l_end, r.r_end) for r in got.collect()) == [("chr1", 0, 40, 40), ("chr1", 40, 90, 90), ("chr13", 0, 70, 70)]


def test_interpolation_equals_numpy(spark):
    rng = random.Random(3)
    bp = sorted(rng.sample(range(10, 900), 25))
    cm = np.cumsum([rng.choice([0.0, 0.25, 0.5]) for _ in bp]).tolist()
    knots = spark.createDataFrame([("1", float(b), c) for b, c in zip(bp, cm, strict=True)], "chrom string, bp double, cm double")
    points = spark.createDataFrame([("1", p) for p in range(0, 1000, 3)], "chrom string, pos long")
    rows = sorted((r.pos, r.cm) for r in maps.interpolate(points, maps.checked_map(knots), 64).collect())
    want = np.interp([p for p, _ in rows], bp, cm)
    assert len(rows) == 334 and np.allclose([c for _, c in rows], want, atol=1e-12)


@pytest.mark.parametrize("rows", [[("1", 5.0, 0.0), ("1", 5.0, 1.0)], [("1", 5.0, 1.0), ("1", 6.0, 0.5)]])
def test_maps_must_ascend(spark, rows):
    with pytest.raises(Exception, match="must ascend"):
        maps.checked_map(spark.createDataFrame(rows, "chrom string, bp double, cm double")).collect()


def test_rates_by_step_and_by_position(spark):
    steps = spark.createDataFrame([("1", 0, 10, 0.5), ("1", 10, 20, 1.5)], SCHEMA + ", u double")
    points = spark.createDataFrame([("1", 9), ("1", 10), ("1", 20)], "chrom string, pos long")
    assert {r.pos: r.u for r in maps.step_lookup(points, steps).collect()} == {9: 0.5, 10: 1.5, 20: None}
    rates = spark.createDataFrame([("1", 9, 2.0), ("1", 10, 3.0)], "chrom string, pos long, u double")
    assert {r.pos: r.u for r in maps.gather(points.where("pos < 20"), rates).collect()} == {9: 2.0, 10: 3.0}
    with pytest.raises(Exception, match="no rate"):
        maps.gather(points, rates).collect()


def test_buckets_make_no_difference(spark, random_spans):
    """Unions, intersections and runs that reach over bucket ends, or end on them."""
    a, b = random_spans(60) + [("1", 0, 35), ("1", 64, 96)], random_spans(60) + [("1", 90, 130)]
    for width in (1, 7, 32, 1 << 20):
        both = [intervals.merge(spark.createDataFrame(x, SCHEMA), width) for x in (a, b)]
        assert [spans(x) for x in both] == [runs_of(covered(x)) for x in (a, b)]
        assert spans(intervals.intersect(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), width=width)) == runs_of(covered(a) & covered(b))
        positions = spark.createDataFrame([("1", p) for p in covered(a)], "chrom string, pos long")
        assert spans(intervals.runs(positions, width)) == runs_of(covered(a))


def test_knots_are_followed_across_stretches(spark):

    rng = random.Random(2)
    rows = [(c, float(p), p / 7) for c in ("a", "b") for p in sorted(rng.sample(range(100_000), 60))]
    knots = spark.createDataFrame(rows, "chrom string, bp double, cm double").repartition(5)
    got = {(r.chrom, r.bp): tuple(r.after) if r.after else None for r in maps.followed(knots, 1000).collect()}
    assert got == {(c, p): next(((q, v) for d, q, v in rows if d == c and q > p), None) for c, p, _ in rows}
    assert maps.checked_map(knots).count() == len(rows)
    for bad in [("a", rows[3][1], 9.0), ("b", 99_999.5, -1.0)]:
        with pytest.raises(Exception, match="must ascend"):
            maps.checked_map(spark.createDataFrame([*rows, bad], "chrom string, bp double, cm double")).collect()


def test_random_tiles_cover_the_whole(spark):
    rows = sorted(tuple(r) for r in intervals.random_tiles(3_000_000, 200.0, spark, 4).collect())
    assert rows[0][0] == 0 and rows[-1][1] == 3_000_000
    assert all(a[1] == b[0] for a, b in zip(rows, rows[1:], strict=False))
    assert sum(e - s for s, e in rows) / len(rows) == pytest.approx(200, rel=0.05)
    assert sorted(tuple(r) for r in intervals.random_tiles(3_000_000, 200.0, spark, 4).collect()) == rows


def test_rows_dealt_by_chromosome_are_merged_by_bucket(spark):
    """Rows that lie by chromosome are dealt out again, or a task would get all of one."""
    rows = [("1", 10 * k, 10 * k + 5 + k % 7) for k in range(200)]
    by_chrom = spark.createDataFrame(rows, SCHEMA).repartition(4, "chrom")
    for got in (intervals.merge(by_chrom, 64), intervals.intersect(by_chrom, by_chrom, width=64)):
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"Exchange hashpartitioning\(chrom#\d+L?, bucket#\d+L?", plan)
        assert spans(got) == runs_of(covered(rows))
