"""Interval files: BED and bedGraph (plain or gzipped), recombination maps, windows, bins."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import write_blocks
from .dense import read_dense


def fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("f"))


def read_bed(spark: SparkSession, path: str, min_length: int | None = None) -> DataFrame:
    """``chrom, start, end``; header lines, whose second field is no number, are left out."""
    f = F.col("f")
    rows = fields(spark, path).where(F.try_element_at(f, F.lit(2)).rlike(r"^[0-9.eE+]+$")).select(
        F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("double").cast("long").alias("start"), F.get(f, F.lit(2)).cast("double").cast("long").alias("end")
    )
    return rows if min_length is None else rows.where(F.col("end") - F.col("start") > min_length)


def write_bed(df: DataFrame, path: str, header: bool = False, compression: str = "none") -> None:
    """One tab-separated file a partition, in order."""
    rows = df.select(F.col("chrom").alias("#chrom"), F.col("start").alias("chromStart"), F.col("end").alias("chromEnd"))
    rows.orderBy("#chrom", "chromStart").write.csv(path, sep="\t", header=header, compression=compression)


#: Names that the first three columns may have.
NAMES = ({"chrom", "#chrom"}, {"start", "chromStart"}, {"end", "chromEnd"})


def read_bedgraph(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """``chrom, start, end`` and the file's other columns as numbers; checks the header."""
    df = spark.read.csv(path, sep=sep, header=True)
    names = df.columns
    if len(names) < 3 or any(n not in ok for n, ok in zip(names, NAMES, strict=False)):
        raise ValueError(f"not a bedGraph header: {names}")
    return df.select(
        F.col(f"`{names[0]}`").alias("chrom"),
        F.col(names[1]).cast("double").cast("long").alias("start"),
        F.col(names[2]).cast("double").cast("long").alias("end"),
        *[F.col(f"`{n}`").cast("double").alias(n) for n in names[3:]],
    )


def read_mutation_map(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """``chrom, start, end, u`` of a bedGraph, a dense array (``.npy``), or a Parquet table ``start, end, u`` or ``pos, u`` of one chromosome.

    A table ``pos, u`` is a dense array, too: positions from 0, without those that lack a rate.
    """
    if not is_table(path) and not is_array(path):
        return read_bedgraph(spark, path)
    df = read_dense(spark, path) if is_array(path) else spark.read.parquet(path)
    if "pos" in df.columns:
        df = df.select(F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "u")
    return df.where(F.col("u").isNotNull() & ~F.isnan("u")).select(F.lit(chrom).alias("chrom"), "start", "end", F.col("u").cast("double").alias("u"))


def is_table(path: str) -> bool:
    return path.rstrip("/").endswith(".parquet")


def is_array(path: str) -> bool:
    return path.endswith(".npy")


def is_dense(spark: SparkSession, path: str) -> bool:
    """Whether a mutation map has a row for each position."""
    return is_array(path) or (is_table(path) and "pos" in spark.read.parquet(path).columns)


def write_bedgraph(df: DataFrame, path: str, sep: str = ",", compression: str = "none") -> None:
    first = [F.col("chrom").alias("#chrom"), F.col("start").alias("chromStart"), F.col("end").alias("chromEnd")]
    rest = [c for c in df.columns if c not in ("chrom", "start", "end")]
    df.select(*first, *rest).orderBy("#chrom", "chromStart").write.csv(path, sep=sep, header=True, compression=compression)


def write_ordered(df: DataFrame, path: str, sep: str = "\t", header: bool = True, overwrite: bool = False) -> None:
    """One sorted, block-gzipped file of ``chrom, start, end`` and other columns, with its header once and an index.

    Nothing has the file's name before it is whole.
    """
    rest = [c for c in df.columns if c not in ("chrom", "start", "end")]
    names = sep.join(["#chrom", "chromStart", "chromEnd", *rest])
    line = F.concat_ws(sep, *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("chrom", "start", "end", *rest)])
    rows = df.select(F.col("chrom").cast("string").alias("chrom"), F.col("start").cast("long").alias("pos"), line.alias("value"))
    write_blocks(rows, path, names if header else "", overwrite)


def read_recombination_map(spark: SparkSession, path: str, chrom: str, map_column: str = "Map(cM)") -> DataFrame:
    """``chrom, bp, cm`` of a map text whose header names ``Position(bp)`` and the map's column."""
    first = spark.read.text(path).first()
    names = first["value"].split() if first else []
    if "Position(bp)" not in names or map_column not in names:
        raise ValueError(f"no such columns in the map's header: {names}")
    bp, cm = names.index("Position(bp)"), names.index(map_column)
    f = F.col("f")
    return fields(spark, path).where(F.get(f, F.lit(bp)) != "Position(bp)").select(
        F.lit(chrom).alias("chrom"), F.get(f, F.lit(bp)).cast("double").alias("bp"), F.get(f, F.lit(cm)).cast("double").alias("cm")
    )


def read_windows(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """``chrom, start, l_end, r_end``; numbers may be written with exponents."""
    f = F.col("f")
    names = ("start", "l_end", "r_end")
    return fields(spark, path).select(
        F.lit(chrom).alias("chrom"), *[F.get(f, F.lit(i)).cast("double").cast("long").alias(n) for i, n in enumerate(names)]
    )


def read_numbered_windows(spark: SparkSession, path: str, chrom: str) -> DataFrame:
    """``chrom, region, start, l_end, r_end`` of one file; a region's name has its number in the file."""
    texts = spark.read.text(path, wholetext=True)
    if texts.count() > 1:
        raise ValueError("windows are numbered by their lines in one file")
    lines = F.filter(F.split("value", r"\r?\n"), lambda line: F.trim(line) != "")
    f = F.split(F.trim("line"), r"\s+")
    numbers = [F.get(f, F.lit(i)).cast("double").cast("long").alias(n) for i, n in enumerate(("start", "l_end", "r_end"))]
    rows = texts.select(F.posexplode(lines).alias("n", "line"))
    return rows.select(F.lit(chrom).alias("chrom"), F.concat_ws("_", F.lit(chrom), F.col("n").cast("string")).alias("region"), *numbers)


def whole_window(spark: SparkSession, chrom: str, end: int) -> DataFrame:
    """A whole chromosome as its one window."""
    return spark.createDataFrame([(chrom, f"{chrom}_0", 0, end, end)], "chrom string, region string, start long, l_end long, r_end long")


def read_edges(spark: SparkSession, path: str) -> list[float]:
    """Bin edges, ascending: a short list by its nature."""
    rows = fields(spark, path).select(F.explode("f").alias("x")).select(F.col("x").cast("double").alias("x")).collect()
    return sorted(r["x"] for r in rows)


def read_cytobands(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    return fields(spark, path).where(~F.get(f, F.lit(0)).startswith("#")).select(
        F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("start"), F.get(f, F.lit(2)).cast("long").alias("end"), F.get(f, F.lit(3)).alias("band")
    )


def read_populations(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(sample, population) in the file's order: a line a sample."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    out = [tuple(line.split()[:2]) for line in text.splitlines() if line.strip()]
    if len({p for _, p in out}) < len(out):
        raise ValueError("population names must be unique")
    return out


def write_statistics(df: DataFrame, path: str, by: str | None = None) -> None:
    """Statistics as Parquet, in place of serialised objects."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).parquet(path)


def read_statistics(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)
