"""Lookups along a chromosome: linear interpolation, step functions, positional rates."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import locate


#: Positions of a stretch in which knots are put in order.
STRETCH = 1 << 22


def followed(knots: DataFrame, width: int = STRETCH) -> DataFrame:
    """``chrom, bp, cm`` with ``after``, the next knot of the chromosome, as struct<bp, cm>; null for the last.

    Knots are put in order by stretch; the last of a stretch is followed by the first of the next
    one that has any, so only a knot a stretch is ordered by chromosome.
    """
    knot = F.struct("bp", "cm")
    placed = knots.withColumn("stretch", F.floor(F.col("bp") / width))
    heads = placed.groupBy(F.col("chrom").alias("of"), F.col("stretch").alias("number")).agg(F.min(knot).alias("head"))
    heads = heads.withColumn("head", F.lead("head").over(Window.partitionBy("of").orderBy("number")))
    inside = placed.withColumn("after", F.lead(knot).over(Window.partitionBy("chrom", "stretch").orderBy("bp", "cm")))
    found = inside.join(heads, (F.col("chrom") == F.col("of")) & (F.col("stretch") == F.col("number")))
    return found.select(*knots.columns, F.coalesce("after", "head").alias("after"))


def checked_map(knots: DataFrame) -> DataFrame:
    """``chrom, bp, cm`` as given; reading it fails where bp doesn't ascend or cm descends."""
    bad = F.coalesce((F.col("after.bp") <= F.col("bp")) | (F.col("after.cm") < F.col("cm")), F.lit(False))
    kept = followed(knots).where(F.when(bad, F.raise_error(F.lit("map positions must ascend"))).isNull())
    return kept.drop("after")


def interpolate(points: DataFrame, knots: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Points with ``cm``, interpolated between the knots of their chromosome, clamped outside."""
    spans = (
        followed(knots.select("chrom", "bp", "cm"))
        .where("after is not null")
        .select("chrom", F.col("bp").alias("start"), F.col("after.bp").alias("end"), F.col("cm").alias("cm0"), F.col("after.cm").alias("cm1"))
        .select(
            "chrom", F.ceil("start").cast("long").alias("start"), F.ceil("end").cast("long").alias("end"),
            F.col("start").alias("bp0"), F.col("end").alias("bp1"), "cm0", "cm1",
        )
        .where("end > start")
    )
    ends = knots.groupBy(F.col("chrom").alias("of")).agg(
        F.min_by("cm", "bp").alias("low"), F.max_by("cm", "bp").alias("high"), F.min("bp").alias("first")
    )
    inside = F.col("cm0") + (F.col("cm1") - F.col("cm0")) * (F.col("pos") - F.col("bp0")) / (F.col("bp1") - F.col("bp0"))
    outside = F.when(F.col("pos") < F.col("first"), F.col("low")).otherwise(F.col("high"))
    return (
        locate(points, spans, "left", width)
        .join(F.broadcast(ends), F.col("chrom") == F.col("of"))  # a row a chromosome
        .select(*points.columns, F.when(F.col("cm0").isNull(), outside).otherwise(inside).alias("cm"))
    )


def step_lookup(points: DataFrame, steps: DataFrame, value: str = "u") -> DataFrame:
    """Points with the value of the interval that holds them; null where none does."""
    return locate(points, steps, "left").drop("start", "end")


def gather(points: DataFrame, rates: DataFrame, value: str = "u") -> DataFrame:
    """Points with the rate at their position; reading it fails where there is none."""
    found = points.join(rates.select("chrom", "pos", value), ["chrom", "pos"], "left")
    return found.withColumn(
        value, F.when(F.col(value).isNull() | F.isnan(value), F.raise_error(F.lit("no rate at a position"))).otherwise(F.col(value))
    )
