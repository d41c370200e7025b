"""Variant files: text scans to ``chrom, pos, ref, alt, gt``, merging, mutation rates.

A block-gzipped file is read in parts, and only where its index says that a region is. Any other
gzipped text is one partition: convert it once with ``write_sites`` and read the Parquet.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .blocks import is_blocked, read_blocks, write_blocks

#: Rate of one MR unit in a mutation file, for a site of two alternative states. Fixed value.
RATE_UNIT = 1.015e-7 / 2
FIXED_COLUMNS = 9
#: Columns of the header line.
HEADER = "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split()


def header(spark: SparkSession, path: str) -> list[str]:
    """Sample ids, from the header line (which stands near the top of the file)."""
    line = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()
    return line["value"].split()[FIXED_COLUMNS:] if line else []


def genotype(sample: Column, allow_missing: bool = False) -> Column:
    """The two alleles of a sample's first field; a missing one fails, or is null if allowed."""
    parts = F.split(F.split(sample, ":")[0], r"[/|]")
    cast = (lambda c: c.try_cast("int")) if allow_missing else (lambda c: c.cast("int"))
    return F.struct(cast(parts[0]).alias("a0"), cast(parts[1]).alias("a1"))


def quality(sample: Column, format_: Column) -> Column:
    """A sample's GQ as a number, null where it is none."""
    at = F.array_position(F.split(format_, ":"), "GQ").cast("int")
    return F.when(at > 0, F.try_element_at(F.split(sample, ":"), at).try_cast("double"))


def lines(spark: SparkSession, path: str, chrom: str | None = None, region: Sequence[int] | None = None) -> DataFrame:
    """``f``: the fields of each line that isn't a header.

    Of a block-gzipped file only what may lie on ``chrom`` (with or without ``chr``) and in ``region`` is read.
    """
    data = ~F.col("value").startswith("#") & (F.length("value") > 0)
    if path.endswith((".gz", ".bgz")) and is_blocked(path):
        rows = read_blocks(spark, path)
        if chrom is not None:
            rows = rows.where(F.col("chrom").isin(chrom, f"chr{chrom}", chrom.removeprefix("chr")))
        if region is not None:
            rows = rows.where((F.col("pos") >= int(region[0])) & (F.col("pos") < int(region[-1])))
        rows = rows.select("value")
    else:
        rows = spark.read.text(path)
    # Filters may be evaluated together with later ones: a header's fields are null for them.
    return rows.where(data).select(F.when(data, F.split("value", r"\s+")).alias("f"))


def biallelic(df: DataFrame) -> DataFrame:
    return df.where(F.size("alt") == 1)


def autosomal(df: DataFrame) -> DataFrame:
    return df.where(F.col("chrom").rlike("^(chr)?[0-9]+$"))


def read_genotypes(
    spark: SparkSession,
    path: str,
    mask: DataFrame | None = None,
    min_length: int | None = None,
    region: tuple[int, ...] | None = None,
    multiallelic: bool = False,
    allow_missing: bool = False,
    samples: list[str] | None = None,
    chrom: str | None = None,
) -> DataFrame:
    """``chrom, pos (from 0), ref, alt, gt, gq`` of a variant file, of one chromosome if given.

    A chromosome gets the name that is asked for, which the file may write with ``chr`` before it.

    The cheap filters (region, alleles) stand before genotypes are parsed; ``mask`` keeps
    positions inside its intervals, those longer than ``min_length`` if given.
    """
    from ..operators.intervals import in_mask, longer_than

    f = F.col("f")
    rows = lines(spark, path, chrom, region).select(F.get(f, F.lit(0)).alias("chrom"), (F.get(f, F.lit(1)).cast("long") - 1).alias("pos"), F.get(f, F.lit(3)).alias("ref"), F.split(F.get(f, F.lit(4)), ",").alias("alt"), F.get(f, F.lit(8)).alias("format"), F.slice(f, FIXED_COLUMNS + 1, F.size(f)).alias("samples"))
    if chrom is not None:
        rows = rows.where(F.regexp_replace("chrom", "^chr", "") == chrom.removeprefix("chr")).withColumn("chrom", F.lit(chrom))
    if region is not None:
        rows = rows.where((F.col("pos") >= region[0]) & (F.col("pos") < region[-1]))
    if not multiallelic:
        rows = biallelic(rows)
    if mask is not None:
        rows = in_mask(rows, mask if min_length is None else longer_than(mask, min_length))
    if samples is not None:
        names = header(spark, path)
        missing = [s for s in samples if s not in names]
        if missing:
            raise ValueError(f"samples that the file doesn't have: {missing}")
        rows = rows.withColumn("samples", F.array(*[F.col("samples")[names.index(s)] for s in samples]))
    return rows.select(
        "chrom", "pos", "ref", "alt",
        F.transform("samples", lambda s: genotype(s, allow_missing)).alias("gt"),
        F.transform("samples", lambda s: quality(s, F.col("format"))).alias("gq"),
    )


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    return lines(spark, path).select(F.get(f, F.lit(0)).alias("chrom"), (F.get(f, F.lit(1)).cast("long") - 1).alias("pos"))


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """Intervals that the file's positions cover."""
    from ..operators.intervals import runs

    return runs(read_positions(spark, path))


def variable(sites: DataFrame) -> DataFrame:
    """Sites where some sample has an allele other than the reference."""
    return sites.where(F.exists("gt", lambda x: (x["a0"] > 0) | (x["a1"] > 0)))


def sample_count(df: DataFrame) -> int:
    row = df.select(F.size("gt").alias("n")).first()
    return row["n"] if row else 0


def merge_variants(*tables: DataFrame, samples: Sequence[int] | None = None) -> DataFrame:
    """``chrom, pos, ref, alt, gt``: samples of all tables side by side, in their order.

    Alternatives are numbered anew: those of the first table that has the site, then what others
    add, and genotypes follow. Where a table lacks a site its samples have the reference; missing
    alleles stay missing. Sites are told apart by their reference, too; where a table repeats a
    site, its n-th row goes with the n-th of the others. ``samples`` are the numbers of samples,
    read from a row of each table if not given.

    All tables move once, whatever their number, by site.
    """
    sizes = list(samples) if samples is not None else [sample_count(t) for t in tables]
    key = ["chrom", "pos", "ref"]
    rows = reduce(DataFrame.unionByName, [t.select(*key, "alt", "gt", F.lit(n).alias("file")) for n, t in enumerate(tables)])
    again = Window.partitionBy(*key, "file").orderBy("alt", F.col("gt").cast("string"))
    # What is dealt by site is dealt by site and anything else.
    rows = rows.repartition(*key).withColumn("nth", F.row_number().over(again))
    found = rows.groupBy(*key, "nth").agg(F.sort_array(F.collect_list(F.struct("file", "alt", "gt"))).alias("of"))  # a row a table
    alts = F.filter(F.array_distinct(F.flatten(F.transform("of", lambda o: o["alt"]))), lambda a: a != ".")

    def renumbered(allele: Column, own: Column) -> Column:
        return F.when(allele > 0, F.array_position(F.col("alts"), F.get(own, allele - 1)).cast("int")).otherwise(allele)

    def of_table(n: int, size: int) -> Column:
        mine = F.get(F.filter("of", lambda o: o["file"] == n), F.lit(0))
        gt = F.transform(mine["gt"], lambda x: F.struct(renumbered(x["a0"], mine["alt"]).alias("a0"), renumbered(x["a1"], mine["alt"]).alias("a1")))
        zero = F.struct(F.lit(0).alias("a0"), F.lit(0).alias("a1"))
        return F.coalesce(gt, F.array_repeat(zero, size))

    every = F.concat(*[of_table(n, size) for n, size in enumerate(sizes)])
    return found.withColumn("alts", alts).select(*key, F.col("alts").alias("alt"), every.alias("gt"))


def summed_rates(rows: DataFrame, unit: float = RATE_UNIT) -> DataFrame:
    """``chrom, pos, u``: MR of ``rows(chrom, pos, info)`` summed over a position's alternatives."""
    rate = F.regexp_extract("info", r"(?:^|;)MR=([^;]+)", 1).try_cast("double")
    return rows.groupBy("chrom", "pos").agg((F.sum(rate) * unit).alias("u")).where("u is not null")


def read_mutation_rates(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    rows = lines(spark, path).select(F.get(f, F.lit(0)).alias("chrom"), (F.get(f, F.lit(1)).cast("long") - 1).alias("pos"), F.get(f, F.lit(7)).alias("info"))
    return summed_rates(autosomal(rows))


def contig_lengths(spark: SparkSession, path: str) -> DataFrame:
    v = F.col("value")
    return spark.read.text(path).where(v.startswith("##contig=")).select(
        F.regexp_extract(v, r"ID=([^,>]+)", 1).alias("chrom"), F.regexp_extract(v, r"length=([0-9]+)", 1).cast("long").alias("length")
    )


def write_sites(sites: DataFrame, path: str) -> None:
    """Parquet, by chromosome and in order of position, so that region scans skip files."""
    sites.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").write.partitionBy("chrom").parquet(path)


def write_variants(sites: DataFrame, path: str, samples: Sequence[str], overwrite: bool = False) -> None:
    """One block-gzipped variant file of ``chrom, pos, ref, alt, gt``, sorted, with its header and index."""
    def allele(x: Column) -> Column:
        return F.coalesce(x.cast("string"), F.lit("."))

    called = F.transform("gt", lambda g: F.concat(allele(g["a0"]), F.lit("/"), allele(g["a1"])))
    alts = F.when(F.size("alt") > 0, F.array_join("alt", ",")).otherwise(".")
    fixed = [F.col("chrom").cast("string"), (F.col("pos") + 1).cast("string"), F.lit("."), F.col("ref"), alts, *[F.lit(x) for x in (".", ".", ".", "GT")]]
    rows = sites.select(F.col("chrom").cast("string").alias("chrom"), F.col("pos").cast("long").alias("pos"), F.concat_ws("\t", *fixed, called).alias("value"))
    write_blocks(rows, path, "##fileformat=VCFv4.2\n" + "\t".join([*HEADER, *samples]), overwrite)
