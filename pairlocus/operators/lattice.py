"""Pairs of covered positions by bins of their distance, counted on intervals.

Positions are covered by disjoint runs, each with a weight (1, or a mutation rate), and distances
are base pairs or those of a recombination map, a line between every two knots. For a first
position x and an edge e let Y(x) be the least position whose map value reaches that of x plus e.
The weight below it, W(Y(x)), is linear in Y(x) within a run, and Y(x) is a rounded-up line in x as
long as neither passes a knot. Runs of first positions are hence cut at knots, at the images of
knots and at those of the ends of runs, and each piece is a sum of rounded-up lines, in a number of
steps that grows with the logarithm of its length. No position is ever a row, and work grows with
runs, knots and edges. Map values are taken as the exact fractions that they are, so that
positions on an edge are told apart whatever the rounding.

Chromosomes are cut into stretches of first positions. A stretch gets the runs and knots that its
largest edge can reach, which a coarse copy of the map (a value for each stretch) tells.
"""

import bisect
import math
from collections.abc import Sequence
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import BUCKET, cut
from .maps import followed, interpolate


def floor_sum(n: int, m: int, a: int, b: int) -> int:
    """The sum of floor((a i + b) / m) over i from 0 to n - 1, for m > 0."""
    total = 0
    while n > 0:
        q, a = divmod(a, m)
        total += q * (n * (n - 1) // 2)
        q, b = divmod(b, m)
        total += q * n
        top = a * n + b
        if top < m:
            break
        # Count lattice points below the line by columns of the other axis.
        n, b = divmod(top, m)
        m, a = a, m
    return total


class Lines:
    """A map as lines by whole positions: segment k holds those from starts[k], with value (a x + b) / d.

    It is made of ``segments``, (bp, cm) of either end, that follow each other, or is base pairs if
    they are None. Outside of the segments it stays as it is at their ends.
    """

    def __init__(self, segments: Sequence[tuple[float, float, float, float]] | None):
        self.starts: list[float | int] = [-math.inf]
        self.lines: list[tuple[int, int, int]] = []
        if segments is None:
            self.lines.append((1, 0, 1))
            return
        ordered = sorted(set(segments))
        self.add(Fraction(0), Fraction(ordered[0][1]) if ordered else Fraction(0))
        for segment in ordered:
            p0, v0, p1, v1 = map(Fraction, segment)
            if math.ceil(p0) < math.ceil(p1):
                slope = (v1 - v0) / (p1 - p0)
                self.starts.append(math.ceil(p0))
                self.add(slope, v0 - slope * p0)
        if ordered:
            self.starts.append(math.ceil(ordered[-1][2]))
            self.add(Fraction(0), Fraction(ordered[-1][3]))

    def add(self, slope: Fraction, constant: Fraction) -> None:
        d = math.lcm(slope.denominator, constant.denominator)
        self.lines.append((int(slope * d), int(constant * d), d))

    def segment(self, x: int) -> int:
        return bisect.bisect_right(self.starts, x) - 1

    def stop(self, k: int) -> float | int:
        return self.starts[k + 1] if k + 1 < len(self.starts) else math.inf

    def last_value(self, k: int) -> tuple[int, int]:
        """The value at the last position of a segment, as numerator and denominator."""
        a, b, d = self.lines[k]
        return (a * (self.stop(k) - 1) + b if a else b), d

    def reaching(self, num: int, den: int, k: int) -> tuple[int, float | int]:
        """The segment, from k on, and the least position whose value is num / den at least; infinite if none is."""
        while k < len(self.lines):
            a, b, d = self.lines[k]
            if a and self.stop(k) == math.inf:
                break
            n, m = self.last_value(k)
            if n * den >= num * m:
                break
            k += 1
        if k == len(self.lines):
            return k, math.inf
        a, b, d = self.lines[k]
        if not a:
            return k, self.starts[k]
        # (a y + b) / d >= num / den
        return k, max(-((b * den - num * d) // (a * den)), self.starts[k])


class Runs:
    """Disjoint runs in order; W(x) is the weight of the positions below x."""

    def __init__(self, starts: Sequence[int], ends: Sequence[int], weights: Sequence):
        self.starts, self.ends, self.weights = list(starts), list(ends), list(weights)
        self.below = [0]
        for s, e, w in zip(self.starts, self.ends, self.weights, strict=True):
            self.below.append(self.below[-1] + w * (e - s))

    def stretch(self, x: float | int) -> tuple[int | float, int | float, object, object]:
        """``low, high, W(low), weight``: the run or gap that holds x, over which W is a line."""
        k = bisect.bisect_right(self.starts, x) - 1
        if k >= 0 and x < self.ends[k]:
            return self.starts[k], self.ends[k], self.below[k], self.weights[k]
        low = self.ends[k] if k >= 0 else -math.inf
        high = self.starts[k + 1] if k + 1 < len(self.starts) else math.inf
        return low, high, self.below[k + 1], 0

    def weight_below(self, x: int):
        low, _, base, w = self.stretch(x)
        return base + w * (x - low) if w else base


def reached(x: int, edge: Fraction, lines: Lines) -> int | float:
    """Y(x)."""
    k = lines.segment(x)
    p, q, d = lines.lines[k]
    return lines.reaching((p * x + q) * edge.denominator + edge.numerator * d, d * edge.denominator, k)[1]


def reaches_of(a: int, b: int, stops: list[int], edge: Fraction, lines: Lines, runs: Runs) -> list:
    """``reach_of`` for each of ``stops``: those that lie behind all Y(x) have the same."""
    if edge <= 0 or len(stops) == 1:
        return [reach_of(a, b, stop, edge, lines, runs) for stop in stops]
    most, top, found = reached(b - 1, edge, lines), max(stops), {}
    for stop in stops:
        end = top if most < stop else stop
        if end not in found:
            found[end] = reach_of(a, b, end, edge, lines, runs)
    return [found[top if most < stop else stop] for stop in stops]


def reach_of(a: int, b: int, stop: int, edge: float | Fraction, lines: Lines, runs: Runs):
    """The sum over x from a to b - 1 of the weight from x + 1 up to Y(x), or up to ``stop``."""
    if edge <= 0 or a >= b:
        return 0
    e = edge if isinstance(edge, Fraction) else Fraction(edge)
    whole, x, ky = 0, a, lines.segment(a)
    end_weight = runs.weight_below(stop)
    while x < b:
        kx = lines.segment(x)
        until = min(b, lines.stop(kx))
        p, q, d = lines.lines[kx]
        # The value to reach: (p x + q) / d + e.
        num, den = (p * x + q) * e.denominator + e.numerator * d, d * e.denominator
        ky, y = lines.reaching(num, den, ky)
        if y >= stop:
            whole += (b - x) * end_weight
            break
        low, high, base, w = runs.stretch(y)
        a2, b2, d2 = lines.lines[ky]
        high = min(high, stop, lines.stop(ky))
        if not a2:
            high = y + 1
        if p:
            # Y(x) < high while the value to reach isn't above that of high - 1.
            at_high = a2 * (high - 1) + b2
            until = min(until, (at_high * d * e.denominator - d2 * (q * e.denominator + e.numerator * d)) // (d2 * p * e.denominator) + 1)
        count = until - x
        if w:
            if p and a2:
                # y = ceil((((p x + q) / d + e) - b2 / d2) * d2 / a2), but not below the segment's start
                scale = d * e.denominator * a2
                slope, start = p * e.denominator * d2, num * d2 - b2 * den
                first = lines.starts[ky]
                clamped = 0
                if first != -math.inf and -((-start) // scale) < first:
                    # While (start + slope i) <= first * scale, Y is the segment's first position.
                    clamped = min(count, (first * scale - start) // slope + 1)
                n = count - clamped
                total = clamped * first if clamped else 0
                total += -floor_sum(n, scale, -slope, -(start + slope * clamped))
            else:
                total = count * y
            whole += count * base + w * (total - count * low)
        else:
            whole += count * base
        x = until
    # Less the weight up to each x itself: x lies in a run.
    low, _, base, w = runs.stretch(a)
    n = b - a
    return whole - (n * base + w * ((a + b - 1) * n // 2 + n - n * low))


def weighted_runs(mask: DataFrame, steps: DataFrame | None = None, value: str = "u", width: int = BUCKET) -> DataFrame:
    """``chrom, start, end, u``: what a merged mask and the steps of a rate map both cover, parts by bucket; 1 without a map."""
    parts = cut(mask, width)
    if steps is None:
        return parts.select("chrom", "start", "end", F.lit(1).cast("long").alias("u"))
    m, s = parts.alias("m"), cut(steps, width, [value]).alias("s")
    both = m.join(s, ["chrom", "bucket"]).where("m.start < s.end and s.start < m.end")
    return both.select("chrom", F.greatest("m.start", "s.start").alias("start"), F.least("m.end", "s.end").alias("end"), F.col(f"s.{value}").alias("u"))


def first_pieces(runs: DataFrame, windows: DataFrame, width: int) -> DataFrame:
    """``chrom, home, region, r_end, start, end, u``: runs of first positions, by window and stretch."""
    r = cut(runs, width, ["u"])
    w = cut(windows.select("chrom", "start", F.least("l_end", "r_end").alias("end"), "region", "r_end"), width, ["region", "r_end"])
    both = w.alias("w").join(r.alias("r"), ["chrom", "bucket"]).where("w.start < r.end and r.start < w.end")
    return both.select("chrom", F.col("bucket").alias("home"), "region", "r_end", F.greatest("w.start", "r.start").alias("start"), F.least("w.end", "r.end").alias("end"), "u")


def values_at(points: DataFrame, knots: DataFrame) -> DataFrame:
    """``points(chrom, pos, ...)`` with ``cm``."""
    return points.join(interpolate(points.select("chrom", "pos").distinct(), knots), ["chrom", "pos"])


def stretches_reached(homes: DataFrame, knots: DataFrame | None, reach: float, width: int, top: DataFrame) -> DataFrame:
    """``chrom, home, last``: the last stretch that the pairs of each home stretch can reach.

    ``top(chrom, last)`` has the last stretch with a run.
    """
    if knots is None:
        found = homes.withColumn("reached", F.floor(((F.col("home") + 1) * width + math.ceil(max(reach, 0))) / width))
    else:
        marks = top.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last") + 1)).alias("mark"))
        marks = values_at(marks.withColumn("pos", F.col("mark") * width), knots)
        line = marks.groupBy("chrom").agg(F.sort_array(F.collect_list("cm")).alias("line"))  # a value a stretch
        ends = values_at(homes.withColumn("pos", (F.col("home") + 1) * width), knots)
        within = F.size(F.filter("line", lambda v: v <= F.col("cm") + reach * (1 + 1e-9) + 1e-9))
        found = ends.join(line, "chrom").withColumn("reached", within)
    return found.join(top, "chrom").select("chrom", "home", F.greatest("home", F.least("reached", "last")).cast("long").alias("last"))


def map_segments(knots: DataFrame, width: int) -> DataFrame:
    """``chrom, bucket, bp0, cm0, bp1, cm1``: each line between two knots, in all stretches that it meets."""
    ends = {"bp0": "bp", "cm0": "cm", "bp1": "after.bp", "cm1": "after.cm"}
    lines = followed(knots.select("chrom", "bp", "cm")).where("after is not null")
    lines = lines.select("chrom", *[F.col(c).cast("double").alias(n) for n, c in ends.items()])
    met = F.sequence(F.floor(F.col("bp0") / width), F.floor(F.col("bp1") / width))
    return lines.select("*", F.explode(met).alias("bucket"))


def interval_rates(runs: DataFrame, windows: DataFrame, width: int = BUCKET) -> DataFrame:
    """``region, num_sites, mean_mut``: covered positions of each window, and the mean of their weights."""
    n = F.col("end") - F.col("start")
    rows = first_pieces(runs, windows, width).groupBy("region").agg(F.sum(n).alias("num_sites"), (F.sum(F.col("u") * n) / F.sum(n)).alias("mean_mut"))
    return windows.select("region").distinct().join(rows, "region", "left").withColumn("num_sites", F.coalesce("num_sites", F.lit(0)))


def interval_pair_sums(
    runs: DataFrame, windows: DataFrame, edges: Sequence[float], knots: DataFrame | None = None, width: int = BUCKET
) -> DataFrame:
    """``chrom, region, bin_id, denom``: sums of u_x u_y over covered pairs x < y, by bins of their distance.

    ``runs(chrom, start, end, u)`` are disjoint, ``windows(chrom, region, start, l_end, r_end)`` may
    overlap: x lies in a window, y below its ``r_end``. Distances are those of ``knots(chrom, bp, cm)``,
    or base pairs. Windows with a covered position have a row for each bin, and one of bin -1 with
    the number of first positions. Weights of a whole-number type give whole numbers.
    """
    edges = [float(e) for e in edges]
    exact = [Fraction(e) for e in edges]
    mapped, whole = knots is not None, runs.schema["u"].dataType.typeName() in ("long", "integer", "short", "byte")
    first = first_pieces(runs, windows, width)
    top = runs.groupBy("chrom").agg(F.floor((F.max("end") - 1) / width).alias("last"))
    homes = stretches_reached(first.select("chrom", "home").distinct(), knots, edges[-1], width, top)
    served = homes.select("chrom", "home", F.explode(F.sequence("home", "last")).alias("bucket"))
    number = "long" if whole else "double"
    kinds = {"region": "string", "r_end": "long", "start": "long", "end": "long", "u": number} | {c: "double" for c in ("bp0", "cm0", "bp1", "cm1")}

    def tagged(df: DataFrame, kind: int) -> DataFrame:
        values = [(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
        return df.select("chrom", "home", F.lit(kind).alias("kind"), *values)

    rows = tagged(first, 0).unionByName(tagged(cut(runs, width, ["u"]).join(served, ["chrom", "bucket"]), 1))
    if mapped:
        rows = rows.unionByName(tagged(map_segments(knots, width).join(served, ["chrom", "bucket"]), 2))

    def one(table: pa.Table) -> pa.Table:
        kind = table["kind"].to_numpy()
        firsts, own, lines = (table.filter(pa.array(kind == k)).sort_by("start") for k in range(3))
        here = Runs(*(own[c].to_pylist() for c in ("start", "end", "u")))
        scale = Lines(list(zip(*(lines[c].to_pylist() for c in ("bp0", "cm0", "bp1", "cm1")), strict=True)) if mapped else None)
        found: dict[str, list] = {}
        # A piece of first positions may lie in several windows.
        pieces: dict[tuple, list] = {}
        for region, stop, a, b, u in zip(*(firsts[c].to_pylist() for c in ("region", "r_end", "start", "end", "u")), strict=True):
            totals = found.setdefault(region, [0] * (len(edges) + 1))
            totals[-1] += b - a
            pieces.setdefault((a, b, u), []).append((totals, stop))
        for (a, b, u), held in pieces.items():
            stops = [stop for _, stop in held]
            for k, e in enumerate(exact):
                for (totals, _), v in zip(held, reaches_of(a, b, stops, e, scale, here), strict=True):
                    totals[k] += u * v
        out = [(region, k if k < len(edges) else -1, v) for region, totals in found.items() for k, v in enumerate(totals)]
        columns = zip(*out, strict=True) if out else ((), (), ())
        kinds = (pa.string(), pa.int32(), pa.int64() if whole else pa.float64())
        made = pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["region", "edge", "total"])
        return made.add_column(0, "chrom", pa.array([table["chrom"][0].as_py()] * len(out), table.schema.field("chrom").type))

    chrom = runs.schema["chrom"].dataType.simpleString()
    sums = rows.groupBy("chrom", "home").applyInArrow(one, f"chrom {chrom}, region string, edge int, total {number}")
    totals = sums.groupBy("chrom", "region", "edge").agg(F.sum("total").alias("total"))
    order = Window.partitionBy("chrom", "region").orderBy("edge")
    denom = F.when(F.col("edge") < 0, F.col("total")).otherwise(F.lead("total").over(order) - F.col("total"))
    return totals.select("chrom", "region", F.col("edge").alias("bin_id"), denom.alias("denom")).where(F.col("bin_id") < len(edges) - 1)
