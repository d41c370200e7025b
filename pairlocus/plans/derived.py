"""Variant data derived from the driver's synthetic tables, by integer arithmetic only."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals

SAMPLES = 4
BP_EDGES = [0, 10, 32, 100, 316, 1000, 3162]
CM_EDGES = [0.0, 0.001, 0.0032, 0.01, 0.032, 0.1, 0.32]
SECOND_EDGES = [1, 10, 60, 600, 3600, 86400]
REGION = 25_000
POPULATIONS = [f"P{s}" for s in range(SAMPLES)]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sites(spark: SparkSession, d: str, *others: str) -> DataFrame:
    """``chrom, pos, gt, u`` and other columns of orders: positions unique and ascending with the order's key."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    alleles = [
        F.struct(
            ((k * (2 * s + 3) + c) % 5 < 2).cast("int").alias("a0"), ((k * (3 * s + 5) + 2 * c) % 7 < 3).cast("int").alias("a1")
        )
        for s in range(SAMPLES)
    ]
    return table(spark, d, "orders").select(
        (c % 4).alias("chrom"), (k * 10 + c % 10).alias("pos"), F.array(*alleles).alias("gt"), (1 + k % 7).alias("u"), *others
    )


#: Samples of the wide table.
MANY = 40


def many_samples(spark: SparkSession, d: str) -> DataFrame:
    """``chrom, pos, gt`` of MANY samples, by the formulas of the first ones."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    gts = [
        F.struct(((k * (2 * s + 3) + c) % 5 < 2).cast("int").alias("a0"), ((k * (3 * s + 5) + 2 * c) % 7 < 3).cast("int").alias("a1"))
        for s in range(MANY)
    ]
    return table(spark, d, "orders").select((c % 4).alias("chrom"), (k * 10 + c % 10).alias("pos"), F.array(*gts).alias("gt"))


def last_position(spark: SparkSession, d: str) -> DataFrame:
    return sites(spark, d).groupBy("chrom").agg((F.max("pos") + 1).alias("end"))


def middles(spark: SparkSession, d: str) -> DataFrame:
    """``of, middle``: half of each chromosome's length."""
    return last_position(spark, d).select(F.col("chrom").alias("of"), F.floor(F.col("end") / 2).alias("middle"))


#: Rows of a series that a task makes.
SERIES = 1 << 14


def series(spark: SparkSession, d: str, step: int, extra: int = 0) -> DataFrame:
    """``chrom, end, k``: k = 0, 1, ... floor(end / step) + extra for each chromosome, made by many tasks.

    A row a chromosome is collected. Rows exploded from those of ``last_position`` would stay in the
    chromosome's task, also for what goes by chromosome and bucket.
    """
    found = None
    for row in last_position(spark, d).where("end is not null").collect():
        n = row["end"] // step + extra + 1
        part = spark.range(0, n, 1, max(2, -(-n // SERIES))).select(
            F.lit(row["chrom"]).cast("long").alias("chrom"), F.lit(row["end"]).cast("long").alias("end"), F.col("id").alias("k")
        )
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "chrom long, end long, k long") if found is None else found


def rec_map(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return series(spark, d, 5000, 1).select("chrom", (k * 5000).alias("bp"), (k * 0.5 + (k % 3) * 0.125).alias("cm"))


def mask(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return series(spark, d, 700).select("chrom", (k * 700).alias("start"), (k * 700 + 400 + (k % 4) * 100).alias("end"))


def second_mask(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return series(spark, d, 1100).select("chrom", (k * 1100 + 50).alias("start"), (k * 1100 + 650).alias("end"))


def step_map(spark: SparkSession, d: str) -> DataFrame:
    """A mutation map of steps of 1000 bp, with gaps."""
    k = F.col("k")
    return series(spark, d, 1000).where("k % 5 <> 4").select("chrom", (k * 1000).alias("start"), ((k + 1) * 1000).alias("end"), (1 + k % 9).alias("u"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """``user_id, at, event_id`` of known users: seconds since 1970, rounded, halves to even ones."""
    at = F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long")
    return table(spark, d, "events").where("user_id is not null").select("user_id", at.alias("at"), "event_id")


def region_name(number: Column) -> Column:
    return F.concat_ws("_", F.col("chrom").cast("string"), number.cast("string"))


def regions(spark: SparkSession, d: str) -> DataFrame:
    """Sites with the region that holds them as first of a pair."""
    return sites(spark, d).withColumn("region", region_name(F.floor(F.col("pos") / REGION)))


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """``chrom, region``: all regions, and one that lies behind the last site of each chromosome."""
    return series(spark, d, REGION, 1).select("chrom", region_name(F.col("k")).alias("region"))


def overlapping(spark: SparkSession, d: str) -> DataFrame:
    """``chrom, region, start, l_end, r_end``: two windows from each start, of one and two tiles, each with its own right end."""
    start = F.floor(F.col("k") / 2) * REGION
    stop = start + (1 + F.col("k") % 2) * REGION
    tile = F.explode(F.array(F.col("k") * 2, F.col("k") * 2 + 1)).alias("k")
    every = series(spark, d, REGION).where(F.col("k") * REGION < F.col("end")).select("chrom", "end", tile)
    return every.select("chrom", region_name(F.col("k")).alias("region"), start.alias("start"), F.least(stop, "end").alias("l_end"), F.least(stop + 5000, "end").alias("r_end"))


def flat_map(spark: SparkSession, d: str) -> DataFrame:
    """A map of binary fractions; every fourth stretch between knots has no recombination."""
    k = F.col("k")
    return series(spark, d, 4096, 1).select("chrom", (k * 4096).alias("bp"), (F.floor(k * 3 / 4) * 0.5).alias("cm"))


def arms(spark: SparkSession, d: str) -> DataFrame:
    """``chrom, start, l_end, r_end`` of tiles of two arms, the last of which begins where the sites end."""
    whole = last_position(spark, d).select("chrom", F.floor(F.col("end") / 2).alias("centromere"), (F.col("end") + REGION).alias("end"))
    return intervals.arm_segments(whole, REGION)


def variant_lines(spark: SparkSession, d: str) -> DataFrame:
    """``value``: lines of a variant file of the sites, two samples with a quality that some lack."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    between = F.when(c % 2 == 0, "/").otherwise("|")
    gts = [F.concat(F.col("gt")[s]["a0"].cast("string"), between, F.col("gt")[s]["a1"].cast("string")) for s in range(2)]
    first = F.concat(gts[0], F.lit(":"), F.when(k % 5 == 0, ".").otherwise((k % 60).cast("string")))
    fields = [
        F.concat(F.lit("chr"), F.col("chrom").cast("string")), (F.col("pos") + 1).cast("string"), F.lit("."), F.lit("A"),
        F.when(F.col("o_orderstatus") == "P", "C,G").otherwise("C"), F.lit("."), F.lit("PASS"), F.lit("DP=3"), F.lit("GT:GQ"),
        first, F.concat(gts[1], F.lit(":7")),
    ]
    rows = sites(spark, d, "o_orderkey", "o_custkey", "o_orderstatus")
    return rows.select(F.concat_ws("\t", *fields).alias("value"))
