"""Column expressions, row places, joins and batches that the operators of this subpackage share."""

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import removed, scratch, temporary, written

__all__ = [
    "WORD", "ascii_lower", "free_name", "hot_join", "located", "numbered", "removed", "scratch", "small_batches", "temporary", "whole_text", "word_count", "written",
]

#: A word of the operators' contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(docs: DataFrame) -> Column:
    """The text of a document, a null one counting as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` folds other letters too, so only texts of one byte a character take it;
    the others are translated letter by letter.
    """
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


# Places of rows


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or the like that ``docs`` has no column of."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


BUCKET, BIT = "bitmap_bucket_number(row)", "bitmap_bit_position(row)"


def placed(docs: DataFrame, at: str) -> DataFrame:
    read = docs.metadataColumn("_metadata")
    return docs.withColumn(at, F.struct(F.xxhash64(read["file_path"]).alias("file"), read["row_index"].alias("row")))


def whole_files(rows: DataFrame, at: str) -> bool:
    """Whether ``rows`` are all rows of some files, each once; a bit a row leaves a task."""
    seen = (
        rows.select(F.col(at)["file"].alias("file"), F.col(at)["row"].alias("row"))
        .groupBy("file", F.expr(BUCKET).alias("part"))
        .agg(F.expr(f"bitmap_count(bitmap_construct_agg({BIT}))").alias("once"), F.count("*").alias("rows"), F.max("row").alias("top"))
        .groupBy("file")
        .agg(F.sum("once").alias("once"), F.sum("rows").alias("rows"), F.max("top").alias("top"))
    )
    return seen.where("rows != once or rows != top + 1").limit(1).count() == 0


def located(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with one more column, struct<file: long, row: long>, and that column's name.

    The place (a hash of the file's path, and the row's number in it) is unique and stays the
    same when a lost task runs again. Where ``docs`` isn't just all rows of some files, each
    once, it is written first and gets the places it has then.
    """
    at = free_name(docs, "_at")
    try:
        rows = placed(docs, at)
        if whole_files(rows, at):
            return rows, at
    except AnalysisException:  # not read from files
        pass
    return placed(written(docs, "rows"), at), at


def numbered(rows: DataFrame, at: str, numbers: DataFrame, most: int, broadcast_mb: int = 64) -> tuple[DataFrame, str]:
    """``rows`` of ``located`` with a number from 0 to ``most`` as one more column, and its name.

    ``numbers(file, row, n)`` has those that aren't 0, a row at most for each place. They are
    bits by place, 4 KB for 32,768 rows of a file, and broadcast while that is less than
    ``broadcast_mb``, so that rows don't move; beyond it both are joined by place.
    """
    name = free_name(rows, "_n")
    bits = numbers.groupBy("file", F.expr(BUCKET).alias("part")).agg(
        *[F.expr(f"bitmap_construct_agg({BIT}) FILTER (WHERE n >= {k})").alias(f"bits{k}") for k in range(1, most + 1)]
    )
    bits = written(bits, "numbers")
    place = rows[f"`{at}`"]
    if bits.count() * most * 4 <= broadcast_mb * 1024:
        part, bit = (F.expr(x.replace("row", f"`{at}`.row")) for x in (BUCKET, BIT))
        powers = F.array(*[F.lit(1 << i) for i in range(8)])

        def has(k: int) -> Column:
            byte = F.substring(bits[f"bits{k}"], (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
            number = F.conv(F.hex(byte), 16, 10).cast("int")
            return F.coalesce(number.bitwiseAND(F.element_at(powers, (bit % 8 + 1).cast("int"))) > 0, F.lit(False))

        found = rows.join(F.broadcast(bits), (place["file"] == bits["file"]) & (part == bits["part"]), "left")
        n = sum((has(k).cast("int") for k in range(1, most + 1)), F.lit(0))
    else:
        side = numbers.select(*[F.col(c).alias(c) for c in ("file", "row", "n")])
        found = rows.join(side, (place["file"] == side["file"]) & (place["row"] == side["row"]), "left")
        n = F.coalesce(side["n"], F.lit(0))
    return found.select(*[rows[f"`{c}`"] for c in rows.columns], n.cast("int").alias(name)), name


# Joins


def hot_join(rows: DataFrame, table: DataFrame, key: str, weight: str, shares: int = 1000) -> DataFrame:
    """Left join of ``rows`` with ``table(key, weight, ...)``, whose key is unique.

    ``weight`` is how many rows have the key. At most ``shares`` keys can have more than
    1/``shares`` of all rows, whatever their number: those few are broadcast and their rows stay
    where they are; the others are joined by shuffle. Null keys match nothing and aren't moved.
    Both inputs are read more than once and should be written tables.
    """
    total = table.agg(F.sum(weight).alias("n")).first()["n"] or 0
    hot = table.where(F.col(weight) * shares > total)
    rest = table.where(F.col(weight) * shares <= total)
    known = rows.where(F.col(key).isNotNull())
    return (
        known.join(F.broadcast(hot), key)
        .unionByName(known.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left"))
        .unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)
    )


# Batches


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 2000, mb: int = 8) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most so many rows, and about so many bytes of a column, each.

    Bounds what a worker makes of a batch; a single longer text is a piece of its own.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(batch):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + (mb << 20), side="right"))))
            yield batch.slice(start, stop - start)
            start = stop
    pa.default_memory_pool().release_unused()  # the worker stays for other tasks
