"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Targets come first: sources, by code point with null last, weigh ``weights`` in turn and
share ``share`` times all words; a source stops at ``limit`` times its own words, and what
it can't take is shared again by weight (water filling in closed form: sources by falling
need per word, prefix sums of limits, one level).

Blocks follow: targets are turned into whole numbers of blocks of ``block`` words by highest
quotients, first over sources, then over the shards of each source. A source has as many
shards as its words fill, so that a source with a third of all rows is many shards, but at most
``most_shards``, which then grow, so that a source's shards are ranked by one task whatever the
input. Inside a shard the documents lie in a seeded order and their words form one line of
blocks; a quota of q blocks of n takes every block q div n times and the first q mod n of that
order once more. What a document gives is the overlap of its stretch with those blocks.

Nulls: a null text has no words; a null source is a source of its own, last; a row without an
id is dealt to a shard by its text. Null or repeated document ids are rows like others. Empty
tables give no rows. Other columns of ``docs`` may have any name.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import located, numbered, whole_text, word_count, written

WEIGHTS = (5, 2, 1)


def source_targets(
    sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, limit: int = 2
) -> DataFrame:
    """``sources(source, source_size)`` with ``weight`` and ``target``: one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ratio = Window.orderBy(
        F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    ranked = (
        sources.withColumn("weight", weight)
        .withColumn("most", (F.col("source_size") * limit).cast("double"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn(
            "filled",
            F.coalesce(
                F.sum("most").over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
            ),
        )
        .withColumn(
            "open", F.sum("weight").over(ratio.rowsBetween(0, Window.unboundedFollowing))
        )
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("open"))
        .withColumn("full", F.col("most") <= F.col("weight") * F.col("level"))
    )
    first_open = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(
        ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return ranked.withColumn(
        "target",
        F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * first_open),
    ).select("source", "source_size", "weight", "target", "total")


def sainte_lague(df: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """Add ``quota``: the ``seats`` of each group dealt to its rows by highest quotients.

    A row's k-th quotient is votes / (k - 1/2). With V votes, S seats and N rows in a group,
    at least S quotients reach V / (S + N/2) and at most S reach V / (S - N/2), so only the
    quotients between the two (about two a row) are ranked; the ones above are sure.
    Equal quotients go by ``key``.
    """
    g = Window.partitionBy(*group)
    v, s = F.col(votes).cast("double"), F.col(seats).cast("double")
    rows = F.sum(F.when(v > 0, 1.0).otherwise(0.0)).over(g)
    all_votes = F.sum(v).over(g)
    low = F.try_divide(all_votes, s + rows / 2)
    high = F.try_divide(all_votes, F.when(s > rows / 2, s - rows / 2))
    bounds = df.withColumn(
        "_sure",
        F.when(v > 0, F.greatest(F.coalesce(F.floor(F.try_divide(v, high) + 0.5) - 1, F.lit(0)), F.lit(0)))
        .otherwise(0)
        .cast("long"),
    ).withColumn(
        "_most", F.when((v > 0) & (low > 0), F.floor(F.try_divide(v, low) + 0.5) + 1).otherwise(0).cast("long")
    )
    bounds = bounds.withColumn("_left", F.col(seats) - F.sum("_sure").over(g))
    extra = bounds.where(F.col("_most") > F.col("_sure")).select(
        *group,
        key,
        "_left",
        F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))).alias("_k"),
        v.alias("_v"),
    )
    best = Window.partitionBy(*group).orderBy(
        (F.col("_v") / (F.col("_k") - 0.5)).desc(), F.col(key).asc_nulls_last(), "_k"
    )
    won = (
        extra.withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= F.col("_left"))
        .groupBy(*[F.col(c).alias(f"_of_{c}") for c in [*group, key]])
        .agg(F.count("*").alias("_won"))
    )
    at = F.lit(True)
    for c in [*group, key]:
        at = at & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return bounds.join(won, at, "left").select(
        *df.columns, (F.col("_sure") + F.coalesce("_won", F.lit(0))).alias("quota")
    )


def seeded(seed: int, key: Column) -> Column:
    """A number in [0, 2^32) from a seed and a string; MD5, so that any engine agrees."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("long")


def mixed_rows(
    docs: DataFrame, at: str, weights: tuple[int, ...], share: float, limit: int, block: int, shard_words: int, most_shards: int, seed: int
) -> DataFrame:
    """``mix`` of rows that ``located`` gave, with their places."""
    sizes = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            F.when(F.col("doc_id").isNull(), F.md5(whole_text(docs))).alias("by_text"),
            F.col(f"`{at}`.file").alias("file"),
            F.col(f"`{at}`.row").alias("row"),
        ),
        "mix-sizes",
    )
    sources = source_targets(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit
    ).withColumn("seats", F.round(F.col("total") / block).cast("long"))
    shards = F.least(F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)), F.lit(most_shards))
    sources = sainte_lague(
        sources.withColumn("_all", F.lit(0)), ["_all"], "source", "target", "seats"
    ).select("source", "source_size", "target", "quota", shards.cast("long").alias("shards"))
    sources = written(sources, "mix-sources")
    dealt = (
        sizes.alias("d")
        .join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
        .select("d.*", "s.source_size", "s.target", "s.shards", "s.quota")
        .withColumn("at", seeded(seed, F.coalesce(F.col("doc_id").cast("string"), "by_text")))
        .withColumn("shard", F.col("at") % F.col("shards"))
        .drop("by_text")
    )
    by_shard = dealt.groupBy("source", "shard").agg(
        F.sum("size").alias("words"), F.max("quota").alias("seats")
    )
    by_shard = sainte_lague(by_shard, ["source"], "shard", "words", "seats").select(
        F.col("source").alias("of"), F.col("shard").alias("part"), "words", F.col("quota").alias("q")
    )
    line = Window.partitionBy("source", "shard").orderBy(
        "at", F.col("doc_id").asc_nulls_first(), "size", "file", "row"
    )
    placed = dealt.withColumn(
        "stop", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))
    )
    blocks = F.greatest(F.ceil(F.col("words") / block), F.lit(1)).cast("long")
    quota = F.least(F.col("q"), blocks * limit)
    joined = placed.join(
        by_shard,
        placed["source"].eqNullSafe(by_shard["of"]) & (placed["shard"] == by_shard["part"]),
        "left",
    ).select(
        *["doc_id", "source", "size", "source_size", "target", "stop", "file", "row"],
        F.floor(quota / blocks).cast("long").alias("times"),
        F.least((quota % blocks) * block, F.col("words")).alias("once_more"),
    )
    start = F.col("stop") - F.col("size")
    taken = F.col("size") * F.col("times") + F.least(F.col("stop"), F.col("once_more")) - F.least(
        start, F.col("once_more")
    )
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "file", "row"
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    limit: int = 2,
    block: int = 32,
    shard_words: int = 1 << 20,
    most_shards: int = 1 << 16,
    seed: int = 7,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: one row for each row of docs.

    ``taken`` is the number of words the mix takes of the document, repeats counted, at most
    ``limit`` times its size. Equal inputs give equal results whatever their partitioning.
    """
    return mixed_rows(*located(docs), weights, share, limit, block, shard_words, most_shards, seed).drop("file", "row")


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    limit: int = 2,
    block: int = 32,
    shard_words: int = 1 << 20,
    most_shards: int = 1 << 16,
    seed: int = 7,
) -> DataFrame:
    """The documents of the mix: each row as many times as the mix takes it, in whole copies.

    Only documents at the ends of a shard's extra blocks are taken in part; each is rounded to
    the nearer number of copies, so that a source is within a document of its target in every
    shard. Keeps all columns of ``docs``.
    """
    rows, at = located(docs)
    taken = mixed_rows(rows, at, weights, share, limit, block, shard_words, most_shards, seed)
    copies = taken.select("file", "row", F.round(F.col("taken") / F.greatest("size", F.lit(1))).cast("int").alias("n"))
    found, n = numbered(rows, at, written(copies.where("n > 0"), "mix-copies"), limit)
    again = F.explode(F.sequence(F.lit(1), F.col(n)))
    return found.where(F.col(n) > 0).withColumn(n, again).drop(at, n)
