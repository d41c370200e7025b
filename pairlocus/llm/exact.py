"""Exact deduplication with streaming state.

Every row gives a digest of its normalised text, its stable identifier and a content locator
(the file and row it was read from). The digests stream into a keyed aggregation whose state
lies on disk (RocksDB, its checkpoint in the shared folder) and never expires: one entry a
digest, with the rows seen and the identifier and locator of the row that stays. A later call
with the same state goes on from there, and a batch that fails is run again from the checkpoint.
Keys are combined before the shuffle, so a text that a third of all rows share is one row a task.

A digest seen more than once is a hit, and hits are checked on full bytes: the texts of hit
digests, found by the digests' hashes where these are few enough to broadcast, are aggregated to
the least and the greatest of each digest before they are shuffled. Where the two agree, all
texts of the digest are one text. Where they differ, which takes a collision of SHA-256, the
rows of that digest are grouped by the text itself. Texts that are unique stay where they are.

Only DataFrame and Structured Streaming operations run on the data.

Nulls: a null text counts as empty; a null identifier is less than any other. Of rows that
repeat an identifier and a text, one stays. Empty tables give no rows. Other columns of ``docs``
may have any name.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import ascii_lower, hot_join, located, numbered, scratch, whole_text, written

#: Settings of the session that runs the stream: state on disk, in memory of a fixed size, and
#: files that take the space they fill.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "15s",
}
ARRIVAL = "doc_id long, digest binary, file long, row long"
#: Hit digests whose hashes are broadcast: 8 bytes each.
FEW_HITS = 1 << 20
#: Arrivals for each partition of the state, each being a store of its own, up to the session's partitions.
STORE_ROWS = 50_000


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def remember(spark: SparkSession, arrivals: str, state: str) -> DataFrame:
    """Stream the digest files in ``arrivals`` through the keyed state under ``state``.

    Files of earlier calls with the same ``state`` aren't read again, while their keys are
    still remembered, in as many partitions as the first call took. Returns ``digest, stays, seen``: the state of every key, as last emitted.
    """
    side = spark.newSession()  # its settings are the stream's own
    for k, v in STATE.items():
        side.conf.set(k, v)
    stores = -(-spark.read.schema(ARRIVAL).parquet(arrivals).count() // STORE_ROWS)
    side.conf.set("spark.sql.shuffle.partitions", str(max(1, min(stores, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    keyed = (
        side.readStream.schema(ARRIVAL)
        .parquet(arrivals)
        .groupBy("digest")
        .agg(F.max(F.struct("doc_id", "file", "row")).alias("stays"), F.count("*").alias("seen"))
    )
    (
        keyed.writeStream.outputMode("update")
        .option("checkpointLocation", f"{state}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{state}/emitted/batch={n}"))
        .start()
        .awaitTermination()
    )
    return (
        spark.read.schema("batch int, digest binary, stays struct<doc_id: long, file: long, row: long>, seen long")
        .parquet(f"{state}/emitted")
        .groupBy("digest")
        .agg(F.max_by("stays", "batch").alias("stays"), F.max("seen").alias("seen"))
    )


def differing_digests(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests of ``hits`` that rows of different texts have, by the bytes of ``rows(text, digest)``."""
    if hits.count() <= FEW_HITS:
        marks = hits.select(F.xxhash64("digest").alias("mark"))
        found = rows.join(F.broadcast(marks), F.xxhash64("digest") == F.col("mark"), "left_semi")
    else:
        found = rows.join(hits.select("digest"), "digest", "left_semi")
    return (
        found.groupBy("digest")
        .agg(F.min("text").alias("least"), F.max("text").alias("greatest"))
        .where("least != greatest")
        .select("digest")
    )


def duplicates(rows: DataFrame, at: str, digest=digest_of) -> DataFrame:
    """``find_duplicates`` of rows that ``located`` gave, with their places."""
    spark = rows.sparkSession
    work = scratch(spark, "exact")
    texts = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(f"`{at}`.file").alias("file"),
        F.col(f"`{at}`.row").alias("row"),
        ascii_lower(whole_text(rows)).alias("text"),
    ).withColumn("digest", digest(F.col("text")))
    sha = F.unhex(F.sha2("text", 256))
    kept = ["doc_id", "digest", "file", "row"]
    texts.select(*kept, *([] if digest is digest_of else [sha.alias("sha")])).write.parquet(f"{work}/digests")
    digests = spark.read.schema(ARRIVAL if digest is digest_of else f"{ARRIVAL}, sha binary").parquet(f"{work}/digests")
    if digest is digest_of:
        digests = digests.withColumn("sha", F.col("digest"))
    hits = written(remember(spark, f"{work}/digests", f"{work}/state").where("seen > 1"), "exact-hits")
    differing = written(differing_digests(texts.select("text", "digest"), hits), "exact-differing")
    collisions = not differing.isEmpty()

    here = (F.col("file") == F.col("stays.file")) & (F.col("row") == F.col("stays.row"))
    agreeing = digests.join(differing, "digest", "left_anti") if collisions else digests
    by_state = hot_join(agreeing, hits, "digest", "seen").select(
        "doc_id",
        "file",
        "row",
        F.when(F.col("seen").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("seen", F.lit(1)).alias("group_size"),
        (F.col("seen").isNull() | here).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    if not collisions:
        return by_state
    collided = texts.join(differing, "digest", "left_semi")
    groups = collided.groupBy("text").agg(F.max(F.struct("doc_id", "file", "row")).alias("stays"), F.count("*").alias("seen"))
    by_text = collided.join(groups, "text").select(
        "doc_id", "file", "row", F.col("stays.doc_id").alias("keep_id"), F.col("seen").alias("group_size"), here.alias("kept"), F.sha2("text", 256).alias("text_sha256")
    )
    return by_state.unionByName(by_text)


def find_duplicates(docs: DataFrame, digest=digest_of) -> DataFrame:
    """``doc_id, file, row, keep_id, group_size, kept, text_sha256``: one row for each row.

    Texts are equal when identical after lower-casing A-Z; of equal ones the row with the
    largest identifier stays. ``digest`` may be any function of the text's column to binary: a
    weaker one sends more rows to the check on bytes and changes no result.
    """
    return duplicates(*located(docs), digest)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, at = located(docs)
    dropped = written(duplicates(rows, at).where(~F.col("kept")).select("file", "row", F.lit(1).alias("n")), "exact-dropped")
    found, n = numbered(rows, at, dropped, 1)
    return found.where(F.col(n) == 0).drop(at, n)
