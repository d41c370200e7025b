"""Half-open intervals [start, end) by chromosome: algebra, lookups, tiling.

Work is cut by buckets of the position, so that no task holds a chromosome: lookups of points in
intervals join on buckets, and merging, sweeping and runs go on within buckets, what touches
a bucket's ends (two rows a bucket at most) being united afterwards.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Positions of a bucket in which intervals are merged.
BUCKET = 1 << 20


def islands(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, start, end``: unions of overlapping and adjacent intervals within ``by``."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(F.col("start") > reached, F.lit(True))).cast("int")).over(order)
    return (
        rows.select(*by, "start", "end", island.alias("island"))
        .groupBy(*by, "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("island")
    )


def cut(intervals: DataFrame, width: int, others: Sequence[str] = ()) -> DataFrame:
    """``chrom, bucket, start, end`` and other columns: the parts of non-empty intervals in each bucket."""
    b = F.col("bucket")
    first, last = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
    return intervals.where("end > start").select("chrom", "start", "end", *others, F.explode(F.sequence(first, last)).alias("bucket")).select(
        "chrom", "bucket", F.greatest("start", b * width).alias("start"), F.least("end", (b + 1) * width).alias("end"), *others
    )


def united(parts: DataFrame, width: int) -> DataFrame:
    """``chrom, start, end``: disjoint parts by bucket, those that meet at bucket ends being one."""
    b = F.col("bucket")
    touch = (F.col("start") == b * width) | (F.col("end") == (b + 1) * width)
    inner = parts.where(~touch).select("chrom", "start", "end")
    return inner.unionByName(islands(parts.where(touch), ["chrom"]).select("chrom", "start", "end"))


def merged_parts(intervals: DataFrame, width: int) -> DataFrame:
    """``chrom, bucket, start, end``: unions within buckets.

    They are dealt by bucket in any case: rows that lie by chromosome would meet Spark's windows as they are.
    """
    return islands(cut(intervals, width).repartition("chrom", "bucket"), ["chrom", "bucket"])


def merge(intervals: DataFrame, width: int = BUCKET) -> DataFrame:
    """Unions of overlapping and adjacent intervals."""
    return united(merged_parts(intervals, width), width)


def intersect(*tables: DataFrame, width: int = BUCKET) -> DataFrame:
    """What all tables cover: in each bucket a sweep over starts and ends of their merged parts."""
    steps = None
    for t in tables:
        m = merged_parts(t, width)
        edges = m.select("chrom", "bucket", F.col("start").alias("pos"), F.lit(1).alias("step")).unionByName(
            m.select("chrom", "bucket", F.col("end").alias("pos"), F.lit(-1).alias("step"))
        )
        steps = edges if steps is None else steps.unionByName(edges)
    order = Window.partitionBy("chrom", "bucket").orderBy("pos")
    depth = (
        steps.groupBy("chrom", "bucket", "pos")
        .agg(F.sum("step").alias("step"))
        .withColumn("depth", F.sum("step").over(order))
        .withColumn("end", F.lead("pos").over(order))
    )
    both = depth.where(F.col("depth") == len(tables)).select("chrom", "bucket", F.col("pos").alias("start"), "end")
    return united(islands(both, ["chrom", "bucket"]), width)


def runs(positions: DataFrame, width: int = BUCKET) -> DataFrame:
    """Maximal runs of consecutive positions."""
    order = Window.partitionBy("chrom", "bucket").orderBy("pos")
    parts = (
        positions.select("chrom", "pos")
        .distinct()
        .withColumn("bucket", F.floor(F.col("pos") / width))
        .withColumn("island", F.col("pos") - F.row_number().over(order))
        .groupBy("chrom", "bucket", "island")
        .agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
        .drop("island")
    )
    return united(parts, width)


def clip(intervals: DataFrame, low, high) -> DataFrame:
    """What lies in [low, high)."""
    s, e = F.greatest("start", F.lit(low)), F.least("end", F.lit(high))
    return intervals.where(s < e).withColumns({"start": s, "end": e})


def positions(intervals: DataFrame, low=None, high=None) -> DataFrame:
    """Every covered position once."""
    covered = merge(intervals)
    if low is not None:
        covered = clip(covered, low, high)
    return covered.select("chrom", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))


def longer_than(intervals: DataFrame, length: int) -> DataFrame:
    return intervals.where(F.col("end") - F.col("start") > length)


def bucketed(intervals: DataFrame, width: int) -> DataFrame:
    """A row for each bucket that an interval meets."""
    return intervals.withColumn(
        "bucket",
        F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))),
    )


def locate(points: DataFrame, intervals: DataFrame, how: str = "inner", width: int = 1 << 16) -> DataFrame:
    """Points with the intervals that hold them; ``how`` may be left, left_semi or left_anti.

    Columns of ``intervals`` other than the chromosome are added but for semi and anti joins.
    """
    p = points.withColumn("bucket", F.floor(F.col("pos") / width)).alias("p")
    i = bucketed(intervals, width).alias("i")
    on = (
        (F.col("p.chrom") == F.col("i.chrom"))
        & (F.col("p.bucket") == F.col("i.bucket"))
        & (F.col("p.pos") >= F.col("i.start"))
        & (F.col("p.pos") < F.col("i.end"))
    )
    joined = p.join(i, on, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("bucket")
    return joined.select("p.*", *[F.col(f"i.{c}") for c in intervals.columns if c != "chrom"]).drop("bucket")


def in_mask(points: DataFrame, mask: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Points that any interval of the mask holds."""
    return locate(points, merge(mask), "left_semi", width)


def segments(lengths: DataFrame, size: int) -> DataFrame:
    """Tiles of ``lengths(chrom, start, end)``: ``start, l_end, r_end`` with r_end the whole's end."""
    tile = F.explode(F.sequence("start", F.col("end") - 1, F.lit(size)))
    return lengths.where("end > start").select("chrom", tile.alias("start"), F.col("end").alias("r_end")).select(
        "chrom", "start", F.least(F.col("start") + size, "r_end").alias("l_end"), "r_end"
    )


def arm_segments(lengths: DataFrame, size: int) -> DataFrame:
    """Tiles of ``lengths(chrom, centromere, end)`` that don't cross the centromere."""
    arms = lengths.select(
        "chrom",
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("long").alias("start"), F.col("centromere").alias("end")),
                F.struct(F.col("centromere").alias("start"), F.col("end")),
            )
        ).alias("arm"),
    ).select("chrom", "arm.*")
    return segments(arms, size)


def plain_tiles(length: int, size: int, spark) -> DataFrame:
    """Tiles of a whole of known length; the last may reach beyond it."""
    return spark.range(0, max(0, -(-length // size))).select(
        (F.col("id") * size).alias("start"), ((F.col("id") + 1) * size).alias("end")
    )


#: Tiles whose lengths are added up in one group.
TILES = 1 << 12


def random_tiles(length: int, scale: float, spark, seed: int = 1) -> DataFrame:
    """``start, end``: tiles with exponential lengths (rounded up) of mean ``scale``, the last one cut at ``length``.

    Lengths come from the MD5 of seed and number, its first 60 bits as a fraction. They are added
    up in groups of numbers, and the sums of the groups before are added to those.
    """
    n = int(4 * length / scale) + 64
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("double") / float(1 << 60)
    sizes = spark.range(0, n).select("id", F.floor(F.col("id") / TILES).alias("group"), F.ceil(-scale * F.ln(1 - drawn)).cast("long").alias("size"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row for TILES tiles
    groups = sizes.groupBy("group").agg(F.sum("size").alias("all")).select("group", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("before"))
    line = Window.partitionBy("group").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    ends = sizes.withColumn("own", F.sum("size").over(line)).join(groups, "group").withColumn("end", F.col("own") + F.col("before"))
    ends = ends.withColumn("start", F.col("end") - F.col("size"))
    return ends.where((F.col("start") < length) & (F.col("size") > 0)).select("start", F.least("end", F.lit(length)).alias("end"))


#: Chromosomes whose short arm holds no sequence to analyse. Fixed values.
ACROCENTRIC = ("13", "14", "15", "21", "22")


def chromosome_arms(bands: DataFrame) -> DataFrame:
    """Windows of cytobands ``chrom, start, end, band``: two arms, or one for acrocentrics."""
    ends = bands.groupBy("chrom").agg(
        F.max("end").alias("end"), F.max(F.when(F.col("band").like("p%"), F.col("end"))).alias("centromere")
    )
    whole = F.regexp_replace("chrom", "^chr", "").isin(*ACROCENTRIC) | F.col("centromere").isNull()

    def row(start, stop):
        return F.struct(start.cast("long").alias("start"), stop.alias("l_end"), stop.alias("r_end"))

    cen = F.coalesce("centromere", F.lit(0).cast("long"))
    arms = F.when(whole, F.array(row(F.lit(0), F.col("end")))).otherwise(
        F.array(row(F.lit(0), cen), row(cen, F.col("end")))
    )
    return ends.select("chrom", F.explode(arms).alias("w")).select("chrom", "w.*")
