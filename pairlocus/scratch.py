"""Tables written to the folder that the cluster shares, in place of cached or local ones."""

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the session names none a temporary one is set, but only if all tasks run on this
    machine: elsewhere executors couldn't read what others write there.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='pairlocus-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_scopes: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder."""
    path = f"{shared_folder(spark)}/pairlocus/{name}-{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    return path


BATCH_ROWS, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int, mb: int) -> Iterator[None]:
    """Arrow batches of at most so many rows and bytes for what runs inside."""
    limits = {BATCH_ROWS: str(rows), BATCH_BYTES: str(mb << 20)}
    before = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, batch_rows: int = 10_000, batch_mb: int = 16) -> DataFrame:
    """Write a DataFrame as Parquet into the shared folder and read it again.

    Cuts the lineage in a way that outlives lost executors, and is read by column. Arrow
    batches on the way are limited, for the time of writing only.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with batches_of(spark, batch_rows, batch_mb):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def removed(df: DataFrame) -> None:
    """Remove the folder of a table that ``written`` made and nothing reads any more."""
    base = f"{shared_folder(df.sparkSession)}/pairlocus/"
    for folder in {base + f.split("/pairlocus/", 1)[1].split("/", 1)[0] for f in df.inputFiles() if "/pairlocus/" in f}:
        deleted(df.sparkSession, folder)


@contextlib.contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Remove at the end all folders that are made inside; results have to be stored by then."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes[:] = [s for s in _scopes if s is not made]
        for folder in made:
            deleted(spark, folder)
