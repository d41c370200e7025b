"""Sums over ordered pairs of sites by bins of their distance.

For sites i before j of a group the distance is at_j - at_i; bin k holds the pairs with
``at_i + edge_k <= at_j < at_i + edge_(k+1)``, so that all plans compare sums, not differences.
The result has a row for every group (as far as it has left sites) and bin.

Three plans give the same numbers:

``halo``   the default: buckets of the position with right sites copied to the buckets that reach
           them, and running sums in NumPy within a bucket. Sites are shuffled once whatever the
           numbers of edges and of values, and left sites are gone through in slices, so a task
           holds its bucket's sites and little more. One chromosome is many tasks.
``ranks``  native: how many sites lie below ``at_i + edge`` comes from running sums in buckets of
           the position plus the totals of the buckets before; pairs are never made, but every
           left site is a row for each edge, and for each value.
``join``   a band self-join by buckets of the position; its work is the number of pairs near each
           other. For few of them, and as a check.
"""

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import BUCKET, cut, locate, merge


def buckets_of(edges: list, width: float) -> tuple[Column, Column]:
    """The first bucket of the position ``at`` that has left sites which reach it, and its own."""
    reach = float(edges[-1]) * (1 + 1e-9)
    first = F.floor((F.col("at") - F.lit(max(reach, 0.0))) / width).cast("long")
    return first, F.floor(F.col("at") / width).cast("long")


def prepared(
    sites: DataFrame, by: list[str], at: str, order: str, value: str | Sequence[str] | None, left: str | None, left_by: list[str]
) -> DataFrame:
    """``by, left_by, at, order, v, l``: what the plans read; sites of value 0 add nothing.

    Of several values ``v`` is an array; a column that is one stays as it is.
    """
    listed = isinstance(value, str) and sites.schema[value].dataType.typeName() == "array"
    several = value is not None and not isinstance(value, str)
    v = F.array(*value) if several else F.col(value) if value else F.lit(1).cast("long")
    rows = sites.select(
        *by,
        *left_by,
        F.col(at).alias("at"),
        F.col(order).alias("order"),
        v.alias("v"),
        (F.coalesce(F.col(left), F.lit(False)) if left else F.lit(True)).alias("l"),
    )
    if several:
        return rows.where(F.exists("v", lambda x: x != 0))
    return rows.where(F.col("v") != 0) if value and not listed else rows


def pair_sums(
    sites: DataFrame,
    edges: Sequence[float],
    by: list[str],
    at: str,
    order: str = "pos",
    value: str | Sequence[str] | None = None,
    left: str | None = None,
    left_by: Sequence[str] = (),
    method: str = "halo",
    buckets: float | None = None,
    expand: Callable[[np.ndarray], Iterator[np.ndarray]] | None = None,
) -> DataFrame:
    """``by, left_by, bin_id, total``: the sum of v_i * v_j over pairs in each bin.

    ``value`` is a column of numbers (1 if not given: pairs are counted), or several columns of
    one type, whose sums get a row each with their number as ``stat_ord``; ``left`` a boolean
    column of sites that may come first; ``left_by`` columns of the first site that also
    group; ``order`` breaks the ties of ``at``. ``buckets`` is the width of a bucket, by default
    the largest edge (at least). With ``expand`` (of ``halo`` only) the columns are no values but what
    they are made of: it gives the values of a task's sites, some columns at a time.
    """
    left_by = list(left_by)
    edges = [type(e)(e) for e in edges]
    rows = prepared(sites, by, at, order, value, left, left_by)
    width = float(buckets or max(edges[-1], 1e-9))
    if method == "halo":
        return by_halo(rows, edges, by, left_by, width, expand)
    if expand is not None:
        raise ValueError("only the method halo makes values of others")
    if value is not None and not isinstance(value, str):
        by = [*by, "stat_ord"]
        rows = rows.select("*", F.posexplode("v").alias("stat_ord", "one")).where("one != 0").drop("v").withColumnRenamed("one", "v")
    plan = {"ranks": by_ranks, "join": by_join}[method]
    sums = plan(rows, edges, by, left_by, width)
    # Bins without pairs are there too.
    kind = sums.schema["total"].dataType
    all_bins = F.explode(F.sequence(F.lit(0), F.lit(len(edges) - 2))).alias("bin_id")
    every = rows.where("l").select(*by, *left_by).distinct().select("*", all_bins)
    same = F.lit(True)
    for c in [*by, *left_by, "bin_id"]:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"s.{c}"))
    return every.alias("e").join(sums.alias("s"), same, "left").select(
        *[F.col(f"e.{c}") for c in [*by, *left_by, "bin_id"]], F.coalesce("s.total", F.lit(0).cast(kind)).alias("total")
    )


def by_join(rows: DataFrame, edges: list, by: list[str], left_by: list[str], width: float) -> DataFrame:
    """Sites meet in buckets of the position, right ones being copied to those that reach them."""
    first, home = buckets_of(edges, width)
    a = rows.where("l").withColumn("bucket", home).alias("a")
    b = rows.drop(*left_by).withColumn("bucket", F.explode(F.sequence(first, home))).alias("b")
    x, y = F.col("a.at"), F.col("b.at")
    on = (F.col("a.bucket") == F.col("b.bucket")) & (y < x + F.lit(edges[-1])) & (y >= x + F.lit(edges[0]))
    on = on & ((y > x) | ((y == x) & (F.col("b.order") > F.col("a.order"))))
    for c in by:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    # Bins follow each other, so a pair lies in the first whose end it doesn't reach.
    place = F.coalesce(*[F.when(y < x + F.lit(e), F.lit(k)) for k, e in enumerate(edges[1:])])
    return (
        a.join(b, on)
        .select(*[F.col(f"a.{c}") for c in [*by, *left_by]], place.alias("bin_id"), (F.col("a.v") * F.col("b.v")).alias("vv"))
        .groupBy(*by, *left_by, "bin_id")
        .agg(F.sum("vv").alias("total"))
    )


def running(rows: DataFrame, by: list[str], width: float) -> DataFrame:
    """Add ``below`` and ``sum_below``: number and sum of v of the sites up to each row.

    Rows are sites (kind 1, counted up to themselves) and probes (kind 0, before all sites of
    their own key). Sums run within buckets of the key; what lies in the buckets before is
    added from their totals.
    """
    placed = rows.withColumn("bucket", F.floor(F.col("key") / F.lit(width)).cast("long"))
    site = F.col("kind")
    totals = placed.groupBy(*by, "bucket").agg(
        F.sum(site).alias("n_in"), F.sum(F.when(site == 1, F.col("v"))).alias("v_in")
    )
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(c).alias(f"t_{c}") for c in [*by, "bucket"]],
        F.coalesce(F.sum("n_in").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("v_in").over(before), F.lit(0)).alias("v_before"),
    )
    same = F.col("bucket") == F.col("t_bucket")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    here = (
        Window.partitionBy(*by, "bucket").orderBy("key", "kind", "order").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        placed.withColumn("n_here", F.sum(site).over(here))
        .withColumn("v_here", F.coalesce(F.sum(F.when(site == 1, F.col("v"))).over(here), F.lit(0)))
        .join(totals, same)
        .withColumn("below", F.col("n_here") + F.col("n_before"))
        .withColumn("sum_below", F.col("v_here") + F.col("v_before"))
        .drop("n_here", "v_here", "n_before", "v_before", "bucket", *[f"t_{c}" for c in [*by, "bucket"]])
    )


def by_ranks(rows: DataFrame, edges: list, by: list[str], left_by: list[str], width: float) -> DataFrame:
    sites = rows.withColumn("key", F.col("at")).withColumn("kind", F.lit(1))
    own = running(sites, by, width)
    probes = own.where("l").select(
        *by,
        *left_by,
        "order",
        "v",
        F.posexplode(F.array(*[F.col("at") + F.lit(e) for e in edges])).alias("edge", "key"),
        F.lit(0).alias("kind"),
        F.col("below").alias("own_rank"),
        F.col("sum_below").alias("own_sum"),
    )
    both = sites.select(*by, "order", "v", "key", "kind").unionByName(probes, allowMissingColumns=True)
    after = running(both, by, width).where("kind = 0")
    reach = F.when(F.col("below") > F.col("own_rank"), F.col("v") * (F.col("sum_below") - F.col("own_sum"))).otherwise(
        F.lit(0)
    )
    cumulative = after.groupBy(*by, *left_by, "edge").agg(F.sum(reach).alias("up_to"))
    bins = Window.partitionBy(*by, *left_by).orderBy("edge")
    return (
        cumulative.withColumn("total", F.lead("up_to").over(bins) - F.col("up_to"))
        .where(F.col("edge") < len(edges) - 1)
        .select(*by, *left_by, F.col("edge").alias("bin_id"), "total")
    )


#: Left sites that a task goes through at a time.
SLICE = 1 << 16


def groups_of(columns: list[np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row's combination of values, and a row that has each of them."""
    codes = np.zeros(rows, np.int64)
    for c in columns:
        values, own = np.unique(c, return_inverse=True)
        codes = codes * len(values) + own
    _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    return codes, first


def binned_sums(at: np.ndarray, v: np.ndarray, first: np.ndarray, codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums by group, bin and value for sites in order; ``first`` are the left ones, of groups ``codes``."""
    order = np.argsort(codes, kind="stable")
    first, codes = first[order], codes[order]
    sums = np.zeros((len(at) + 1, v.shape[1]), v.dtype)
    np.cumsum(v, axis=0, out=sums[1:])
    out = np.zeros((int(codes.max(initial=-1)) + 1, len(edges) - 1, v.shape[1]), v.dtype)
    for start in range(0, len(first), SLICE):
        left, own = first[start : start + SLICE], codes[start : start + SLICE]
        runs = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        reached = [np.maximum(np.searchsorted(at, at[left] + e), left + 1) for e in edges]
        for k, (low, high) in enumerate(zip(reached, reached[1:], strict=False)):
            out[own[runs], k] += np.add.reduceat((sums[high] - sums[low]) * v[left], runs, axis=0)
    return out


def whole_number(kind: str) -> bool:
    return kind in ("long", "integer", "short", "byte")


def matrix_of(column: pa.ChunkedArray, several: bool, number: type) -> np.ndarray:
    """A row of values for each site."""
    v = column.combine_chunks()
    return (v.flatten() if several else v).to_numpy(zero_copy_only=False).astype(number, copy=False).reshape(len(column), -1)


def as_they_are(v: np.ndarray) -> Iterator[np.ndarray]:
    yield v


def by_halo(
    rows: DataFrame, edges: list, by: list[str], left_by: list[str], width: float, expand: Callable[[np.ndarray], Iterator[np.ndarray]] | None = None
) -> DataFrame:
    first, last = buckets_of(edges, width)
    copied = rows.withColumn("home", last).withColumn("bucket", F.explode(F.sequence(first, last)))
    kind = rows.schema["v"].dataType
    several = kind.typeName() == "array"
    whole = whole_number((kind.elementType if several else kind).typeName())
    steps, number = np.array(edges, float), np.int64 if whole else np.float64
    made, shipped = expand or as_they_are, np.int8 if expand else number

    def one(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("at", "ascending"), ("order", "ascending")]).combine_chunks()
        v, at = matrix_of(table["v"], several, shipped), table["at"].to_numpy().astype(float)
        left = np.flatnonzero(table["l"].to_numpy() & (table["home"].to_numpy() == table["bucket"].to_numpy()))
        kept = table.take(pa.array(left)).select([*by, *left_by])
        codes, heads = groups_of([kept[c].to_numpy() for c in left_by], len(left)) if len(left) else (left, left)
        sums = np.concatenate([binned_sums(at, block, left, codes, steps) for block in made(v)], axis=2)
        groups, bins, stats = sums.shape
        out = kept.take(pa.array(np.repeat(heads, bins * stats)))
        if several:
            out = out.append_column("stat_ord", pa.array(np.tile(np.arange(stats, dtype=np.int32), groups * bins)))
        out = out.append_column("bin_id", pa.array(np.tile(np.repeat(np.arange(bins, dtype=np.int32), stats), groups)))
        return out.append_column("total", pa.array(sums.reshape(-1)))

    keys = [*by, *left_by, *(["stat_ord"] if several else [])]
    fields = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in [*by, *left_by])
    schema = f"{fields}{'stat_ord int, ' if several else ''}bin_id int, total {'long' if whole else 'double'}"
    return copied.groupBy(*by, "bucket").applyInArrow(one, schema).groupBy(*keys, "bin_id").agg(F.sum("total").alias("total"))


def limited_sums(at: np.ndarray, pos: np.ndarray, v: np.ndarray, left: dict[str, np.ndarray], edges: np.ndarray) -> np.ndarray:
    """Sums by group, bin and value of left sites with the sites in order behind them and below their ``stop``.

    ``left`` has ``at, pos, v, stop`` and the group's number as ``code``.
    """
    order = np.argsort(left["code"], kind="stable")
    left = {k: x[order] for k, x in left.items()}
    sums = np.zeros((len(at) + 1, v.shape[1]), v.dtype)
    np.cumsum(v, axis=0, out=sums[1:])
    out = np.zeros((int(left["code"].max(initial=-1)) + 1, len(edges) - 1, v.shape[1]), v.dtype)
    for start in range(0, len(order), SLICE):
        part = {k: x[start : start + SLICE] for k, x in left.items()}
        own = part["code"]
        runs = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        low, high = np.searchsorted(pos, part["pos"], side="right"), np.searchsorted(pos, part["stop"])
        reached = [np.clip(np.searchsorted(at, part["at"] + e), low, np.maximum(high, low)) for e in edges]
        for k, (a, b) in enumerate(zip(reached, reached[1:], strict=False)):
            out[own[runs], k] += np.add.reduceat((sums[b] - sums[a]) * part["v"], runs, axis=0)
    return out


EMPTY = pa.schema([("chrom", pa.string()), ("region", pa.string()), ("stat_ord", pa.int32()), ("bin_id", pa.int32()), ("total", pa.int64())]).empty_table()


def windowed_pair_sums(
    sites: DataFrame,
    windows: DataFrame,
    edges: Sequence[float],
    at: str = "pos",
    value: Sequence[str] | None = None,
    buckets: float | None = None,
    expand: Callable[[np.ndarray], Iterator[np.ndarray]] | None = None,
) -> DataFrame:
    """``chrom, region, stat_ord, bin_id, total``: pairs whose first site lies in a window, the second below its ``r_end``.

    ``windows(chrom, region, start, l_end, r_end)`` may overlap, each with its own right end. Sites
    move once as second ones and once for each window that holds them as first ones; ``at``
    mustn't fall where the position ``pos`` rises. Windows with a first site have a row for each
    value (1 if none is given) and bin. ``expand`` is that of ``pair_sums``.
    """
    edges = [float(e) for e in edges]
    width, reach = float(buckets or max(edges[-1], 1e-9)), max(edges[-1] * (1 + 1e-9), 0.0)
    values = F.array(F.lit(1).cast("long")) if not value else F.col(value) if isinstance(value, str) else F.array(*value)
    rows = sites.select("chrom", "pos", F.col(at).alias("at"), values.alias("v"))
    whole = whole_number(rows.schema["v"].dataType.elementType.typeName())
    number, size = (np.int64, "long") if whole else (np.float64, "double")
    made, shipped = expand or as_they_are, np.int8 if expand else number
    home = F.floor(F.col("at") / width).cast("long")
    # Second sites that add nothing needn't move; a window counts its first ones all the same.
    right = rows.where(F.exists("v", lambda x: x != 0)).withColumn("bucket", F.explode(F.sequence(F.floor((F.col("at") - reach) / width).cast("long"), home)))
    inside = windows.select("chrom", "start", F.least("l_end", "r_end").alias("end"), "region", "r_end")
    left = locate(rows, inside).select(*rows.columns, home.alias("bucket"), "region", "r_end")
    steps = np.array(edges)

    def one(table: pa.Table) -> pa.Table:
        second = table.filter(pc.is_null(table["region"])).sort_by([("at", "ascending"), ("pos", "ascending")])
        first = table.filter(pc.is_valid(table["region"]))
        names = first["region"].combine_chunks().dictionary_encode()
        own = {"at": first["at"].to_numpy().astype(float), "pos": first["pos"].to_numpy(), "stop": first["r_end"].to_numpy(), "code": names.indices.to_numpy().astype(np.int64)}
        if not len(first):
            return EMPTY.cast(pa.schema([("chrom", table.schema.field("chrom").type), *list(EMPTY.schema)[1:-1], ("total", pa.int64() if whole else pa.float64())]))
        # Sites of both sides as one matrix, so that an empty side has as many columns.
        both = matrix_of(pa.chunked_array([*first["v"].chunks, *second["v"].chunks]), True, shipped)
        at, pos = second["at"].to_numpy().astype(float), second["pos"].to_numpy()
        parts = [limited_sums(at, pos, block[len(first) :], own | {"v": block[: len(first)]}, steps) for block in made(both)]
        sums = np.concatenate(parts, axis=2)
        groups, bins, stats = sums.shape
        out = pa.table({
            "region": names.dictionary.take(pa.array(np.repeat(np.arange(groups), bins * stats))),
            "stat_ord": pa.array(np.tile(np.arange(stats, dtype=np.int32), groups * bins)),
            "bin_id": pa.array(np.tile(np.repeat(np.arange(bins, dtype=np.int32), stats), groups)),
            "total": pa.array(sums.reshape(-1)),
        })
        return out.add_column(0, "chrom", pa.array([table["chrom"][0].as_py()] * len(out), table.schema.field("chrom").type))

    chrom = rows.schema["chrom"].dataType.simpleString()
    both = left.unionByName(right, allowMissingColumns=True)
    found = both.groupBy("chrom", "bucket").applyInArrow(one, f"chrom {chrom}, region string, stat_ord int, bin_id int, total {size}")
    return found.groupBy("chrom", "region", "stat_ord", "bin_id").agg(F.sum("total").alias("total"))


def covered_below(runs: DataFrame, probes: DataFrame, width: int = BUCKET) -> DataFrame:
    """``probes(chrom, x, ...)`` with ``c`` and ``p``: number and sum of the positions below x that ``runs`` cover.

    ``runs`` are merged. Sums run within buckets of the position; what lies in the buckets before
    is added from their totals.
    """
    n = F.col("end") - F.col("start")
    parts = cut(runs, width).select(
        "chrom", "bucket", F.col("start").alias("x"), F.lit(False).alias("probe"), "end", n.alias("n"), ((F.col("start") + F.col("end") - 1) * n / 2).cast("long").alias("s")
    )
    asked = probes.select(*probes.columns, F.floor(F.col("x") / width).alias("bucket"), F.lit(True).alias("probe"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"))
    rows = parts.unionByName(asked, allowMissingColumns=True)
    before = Window.partitionBy("of").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col("chrom").alias("of"), F.col("bucket").alias("number")).agg(F.sum("n").alias("n_in"), F.sum("s").alias("s_in"))
    totals = totals.select("of", "number", *[F.coalesce(F.sum(f"{c}_in").over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "s")])
    here = Window.partitionBy("chrom", "bucket").orderBy("x", "probe").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select("*", F.sum("n").over(here).alias("n_here"), F.sum("s").over(here).alias("s_here"), F.max("end").over(here).alias("reached")).where("probe")
    # The latest run may reach beyond x.
    over = F.greatest(F.coalesce(F.col("reached") - F.col("x"), F.lit(0)), F.lit(0))
    beyond = (over * (F.col("x") + F.col("reached") - 1) / 2).cast("long")
    return found.join(totals, (F.col("chrom") == F.col("of")) & (F.col("bucket") == F.col("number"))).select(
        *probes.columns,
        (F.col("n_before") + F.col("n_here") - over).alias("c"),
        (F.col("s_before") + F.col("s_here") - F.coalesce(beyond, F.lit(0))).alias("p"),
    )


def mask_pair_counts(mask: DataFrame, windows: DataFrame, edges: Sequence[float], width: int = BUCKET) -> DataFrame:
    """``chrom, region, bin_id, denom``: pairs of positions of a mask by bins of their distance in base pairs.

    The first position lies in a window ``chrom, region, start, l_end, r_end``, the second below
    its ``r_end``. Works on intervals, not on positions: with C(x) covered positions below x, and
    p the sum of them, the sum of C(y) over y < x is (x - 1) C(x) - p, so a run of first positions
    takes two lookups an edge. The row of bin -1 has the number of first positions.
    """
    runs = merge(mask, width)
    w, r = cut(windows.select("chrom", F.col("start").alias("start"), F.col("l_end").alias("end"), "region", "r_end"), width, ["region", "r_end"]), cut(runs, width)
    first = w.alias("w").join(r.alias("r"), ["chrom", "bucket"]).where("w.start < r.end and r.start < w.end").select(
        "chrom", "region", "r_end", F.greatest("w.start", "r.start").alias("a"), F.least("w.end", "r.end").alias("b")
    )
    steps = [max(math.ceil(e), 1) for e in edges]
    asked = first.select("*", F.posexplode(F.array(*[F.lit(e).cast("long") for e in steps])).alias("edge", "e"))
    # First positions from the turn on see all up to r_end.
    turn = F.col("r_end") - F.col("e")
    low, high = F.col("a"), F.least("b", F.greatest(turn, F.col("a")))
    points = F.array(
        F.struct((low + F.col("e")).alias("x"), F.lit(-1).cast("long").alias("g"), F.lit(0).cast("long").alias("k")),
        F.struct((high + F.col("e")).alias("x"), F.lit(1).cast("long").alias("g"), F.lit(0).cast("long").alias("k")),
        F.struct(F.col("r_end").alias("x"), F.lit(0).cast("long").alias("g"), (F.col("b") - high).alias("k")),
    )
    probes = asked.select("chrom", "region", "edge", F.explode(points).alias("q")).select("chrom", "region", "edge", "q.x", "q.g", "q.k").where("g != 0 or k != 0")
    reach = covered_below(runs, probes, width).groupBy("chrom", "region", "edge").agg(
        F.sum(F.col("g") * ((F.col("x") - 1) * F.col("c") - F.col("p")) + F.col("k") * F.col("c")).alias("up_to")
    )
    order = Window.partitionBy("chrom", "region").orderBy("edge")
    pairs = reach.select("chrom", "region", F.col("edge").alias("bin_id"), (F.lead("up_to").over(order) - F.col("up_to")).alias("denom"))
    sites = first.groupBy("chrom", "region").agg(F.lit(-1).alias("bin_id"), F.sum(F.col("b") - F.col("a")).alias("denom"))
    return pairs.where(F.col("bin_id") < len(edges) - 1).unionByName(sites)


def mean_product(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``mean_mut_prod, num_sites, mean_mut, sqr_mean_mut``: u_i u_j over all pairs, in one pass."""
    s, q, n = F.sum(value), F.sum(F.col(value) * F.col(value)), F.count(value)
    return rows.groupBy(*by).agg(
        n.alias("num_sites"),
        F.avg(value).alias("mean_mut"),
        (F.avg(value) * F.avg(value)).alias("sqr_mean_mut"),
        (((s * s - q) / 2) / F.nullif(n * (n - 1) / 2, F.lit(0.0))).alias("mean_mut_prod"),
    )
