"""Queries over the driver's tables, each with SQL that another engine can run.

The SQL is brute force where the query is clever: pair sums are self-joins, lookups are range
joins, so that agreement says something.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import genetics as g
from ..operators import bootstrap as boot
from ..operators import hstats, intervals, lattice, likelihood, maps, pairs, quadrature, views
from ..operators.container import Statistics
from ..scratch import scratch, written
from ..sources import bed, dense, vcf
from . import derived as t

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Common table expressions of the oracles

SITES = f"""sites AS (
    SELECT o_custkey % 4 AS chrom, o_orderkey * 10 + o_custkey % 10 AS pos, 1 + o_orderkey % 7 AS u,
           {", ".join(f"CAST((o_orderkey*{2 * s + 3} + o_custkey) % 5 < 2 AS INT) AS a{s}, CAST((o_orderkey*{3 * s + 5} + 2*o_custkey) % 7 < 3 AS INT) AS b{s}" for s in range(t.SAMPLES))}
    FROM orders)"""
ENDS = "ends AS (SELECT chrom, max(pos) + 1 AS stop FROM sites GROUP BY chrom)"


def series(name: str, step: int, columns: str, extra: int = 0, where: str = "true") -> str:
    """A table of ``columns`` in k for k = 0, 1, ... as far as each chromosome reaches."""
    return (
        f"{name} AS (SELECT chrom, {columns} FROM ends, (SELECT unnest(generate_series(0, (SELECT max(stop) FROM ends) // {step} + 1)) AS k) AS ks"
        f" WHERE k <= stop // {step} + {extra} AND {where})"
    )


MASK = series("mask", 700, "k*700 AS lo, k*700 + 400 + (k % 4)*100 AS hi")
MASK2 = series("mask2", 1100, "k*1100 + 50 AS lo, k*1100 + 650 AS hi")
STEPS = series("steps", 1000, "k*1000 AS lo, (k+1)*1000 AS hi, 1 + k % 9 AS rate", 0, "k % 5 <> 4")


def merged_sql(name: str, source: str) -> str:
    return f"""{name} AS (SELECT chrom, min(lo) AS lo, max(hi) AS hi FROM (
        SELECT chrom, lo, hi, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY lo, hi) AS island
        FROM (SELECT chrom, lo, hi, max(hi) OVER (PARTITION BY chrom ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {source}) AS x) AS y
        GROUP BY chrom, island)"""


def bins(edges: list) -> str:
    rows = ", ".join(f"({k}, {a!r}, {b!r})" for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    return f"bins(bin_id, lo, hi) AS (VALUES {rows})"


BP = bins(t.BP_EDGES)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def pair_sql(value: str = "1", where: str = "true", edges: str = BP, by: str = "l.chrom AS chrom", group: str = "l.chrom") -> str:
    """Pairs by bins, with bins that have none."""
    return f"""WITH {SITES}, {ENDS}, {edges}, groups AS (SELECT DISTINCT {by} FROM sites AS l WHERE {where}),
        found AS (SELECT {by}, bin_id, sum({value}) AS total FROM sites AS l JOIN sites AS r ON l.chrom = r.chrom AND r.pos > l.pos AND r.pos < l.pos + 3162
                  JOIN bins ON r.pos >= l.pos + bins.lo AND r.pos < l.pos + bins.hi WHERE {where} GROUP BY {group}, bin_id)"""


# Pairs

PLAIN = pair_sql() + """ SELECT g.chrom, CAST(b.bin_id AS BIGINT) AS bin_id, CAST(coalesce(f.total, 0) AS BIGINT) AS total
    FROM groups AS g CROSS JOIN bins AS b LEFT JOIN found AS f ON f.chrom = g.chrom AND f.bin_id = b.bin_id"""


@query(PLAIN)
def pair_counts_orders(spark: SparkSession, d: str) -> DataFrame:
    return long(pairs.pair_sums(t.sites(spark, d), t.BP_EDGES, ["chrom"], "pos"), "bin_id")


@query(PLAIN)
def pair_counts_ranks(spark: SparkSession, d: str) -> DataFrame:
    return long(pairs.pair_sums(t.sites(spark, d), t.BP_EDGES, ["chrom"], "pos", method="ranks"), "bin_id")


#: As many edges as a usual file of bins has.
MANY_EDGES = [0, *[round(10 ** (1 + 2.5 * k / 20)) for k in range(20)]]


@query(PLAIN.replace(BP, bins(MANY_EDGES)).replace("l.pos + 3162", f"l.pos + {MANY_EDGES[-1]}"))
def pair_counts_21_edges(spark: SparkSession, d: str) -> DataFrame:
    return long(pairs.pair_sums(t.sites(spark, d), MANY_EDGES, ["chrom"], "pos"), "bin_id")


@query(PLAIN)
def pair_counts_join(spark: SparkSession, d: str) -> DataFrame:
    return long(pairs.pair_sums(t.sites(spark, d), t.BP_EDGES, ["chrom"], "pos", method="join"), "bin_id")


VALUES = pair_sql("l.u * r.u") + """ SELECT g.chrom, CAST(b.bin_id AS BIGINT) AS bin_id, CAST(coalesce(f.total, 0) AS BIGINT) AS total
    FROM groups AS g CROSS JOIN bins AS b LEFT JOIN found AS f ON f.chrom = g.chrom AND f.bin_id = b.bin_id"""


@query(VALUES)
def prod_sums_orders(spark: SparkSession, d: str) -> DataFrame:
    return long(pairs.pair_sums(t.sites(spark, d), t.BP_EDGES, ["chrom"], "pos", value="u"), "bin_id")


@query(VALUES.replace("CAST(coalesce(f.total, 0) AS BIGINT) AS total", "round(coalesce(f.total, 0) * 1e-6, 9) AS total"))
def mut_prod_sums(spark: SparkSession, d: str) -> DataFrame:
    rates = t.sites(spark, d).withColumn("rate", F.col("u") * 1e-3)
    sums = pairs.pair_sums(rates, t.BP_EDGES, ["chrom"], "pos", value="rate")
    return long(sums, "bin_id").withColumn("total", F.round("total", 9))


@query(
    pair_sql(where="l.pos < (SELECT stop // 2 FROM ends WHERE ends.chrom = l.chrom)")
    + """ SELECT g.chrom, CAST(b.bin_id AS BIGINT) AS bin_id, CAST(coalesce(f.total, 0) AS BIGINT) AS total
    FROM groups AS g CROSS JOIN bins AS b LEFT JOIN found AS f ON f.chrom = g.chrom AND f.bin_id = b.bin_id"""
)
def pair_counts_left_limited(spark: SparkSession, d: str) -> DataFrame:
    middles = F.broadcast(t.middles(spark, d))  # a row a chromosome
    sites = t.sites(spark, d).join(middles, F.col("chrom") == F.col("of")).withColumn("first", F.col("pos") < F.col("middle"))
    return long(pairs.pair_sums(sites, t.BP_EDGES, ["chrom"], "pos", left="first"), "bin_id")


@query(
    f"""WITH e AS (SELECT user_id, CAST(epoch(ts) AS BIGINT) AS at, event_id FROM events), {bins(t.SECOND_EDGES)},
    found AS (SELECT bin_id, count(*) AS total FROM e AS l JOIN e AS r ON l.user_id = r.user_id
              AND (r.at > l.at OR (r.at = l.at AND r.event_id > l.event_id)) AND r.at < l.at + 86400
              JOIN bins ON r.at >= l.at + bins.lo AND r.at < l.at + bins.hi GROUP BY bin_id)
    SELECT CAST(b.bin_id AS BIGINT) AS bin_id, CAST(coalesce(total, 0) AS BIGINT) AS total FROM bins AS b LEFT JOIN found AS f ON f.bin_id = b.bin_id"""
)
def pair_counts_events_by_user(spark: SparkSession, d: str) -> DataFrame:
    sums = pairs.pair_sums(t.events(spark, d), t.SECOND_EDGES, ["user_id"], "at", order="event_id", buckets=1e7)
    every = spark.range(len(t.SECOND_EDGES) - 1).select(F.col("id").alias("bin_id"))  # bins without pairs are there too
    found = every.join(sums.groupBy("bin_id").agg(F.sum("total").alias("total")), "bin_id", "left")
    return found.select("bin_id", F.coalesce("total", F.lit(0)).cast("long").alias("total"))


@query(
    f"""WITH {SITES}, {bins(t.CM_EDGES)}, m AS (SELECT chrom, pos, (pos // 5000)*0.5 + ((pos // 5000) % 3)*0.125
        + (((pos // 5000 + 1)*0.5 + ((pos // 5000 + 1) % 3)*0.125) - ((pos // 5000)*0.5 + ((pos // 5000) % 3)*0.125)) * (pos - (pos // 5000)*5000) / 5000.0 AS cm FROM sites),
    found AS (SELECT l.chrom AS chrom, bin_id, count(*) AS total FROM m AS l JOIN m AS r ON l.chrom = r.chrom AND r.pos > l.pos AND r.cm < l.cm + 0.32
              JOIN bins ON r.cm >= l.cm + bins.lo AND r.cm < l.cm + bins.hi GROUP BY l.chrom, bin_id)
    SELECT g.chrom, CAST(b.bin_id AS BIGINT) AS bin_id, CAST(coalesce(f.total, 0) AS BIGINT) AS total
    FROM (SELECT DISTINCT chrom FROM sites) AS g CROSS JOIN bins AS b LEFT JOIN found AS f ON f.chrom = g.chrom AND f.bin_id = b.bin_id"""
)
def pair_counts_cm(spark: SparkSession, d: str) -> DataFrame:
    mapped = maps.interpolate(t.sites(spark, d).select("chrom", "pos"), t.rec_map(spark, d))
    return long(pairs.pair_sums(mapped, t.CM_EDGES, ["chrom"], "cm"), "bin_id")


# Heterozygosity

TRIANGLE = hstats.triangle(t.SAMPLES)


def quarter(i: int, j: int) -> str:
    if i == j:
        return f"4 * CAST(a{i} <> b{i} AS INT)"
    return " + ".join(f"CAST({x}{i} <> {y}{j} AS INT)" for x in "ab" for y in "ab")


LONG = f"d AS ({' UNION ALL '.join(f'SELECT chrom, pos, u, {n} AS stat_ord, {quarter(i, j)} AS d4 FROM sites' for n, i, j in TRIANGLE)})"


EVERY_STATISTIC = f"stats(stat_ord) AS (VALUES {', '.join(f'({n})' for n, _, _ in TRIANGLE)})"


def h_sql(where: str) -> str:
    return f"""WITH {SITES}, {LONG} SELECT chrom, CAST(stat_ord AS BIGINT) AS stat_ord, CAST(sum(d4) AS DOUBLE) / 4 AS num
        FROM d WHERE {where} GROUP BY chrom, stat_ord"""


ONE = [n for n, i, j in TRIANGLE if i == j]
TWO = [n for n, i, j in TRIANGLE if i != j]


def listed(x: list[int]) -> str:
    return f"stat_ord IN ({', '.join(map(str, x))})"


@query(h_sql("true"))
def h_triangle(spark: SparkSession, d: str) -> DataFrame:
    return long(hstats.one_locus(t.sites(spark, d), t.SAMPLES, ["chrom"]), "stat_ord")


@query(
    f"""WITH {SITES}, {LONG} SELECT chrom, CAST(CASE stat_ord {' '.join(f'WHEN {n} THEN {k}' for k, n in enumerate(ONE))} END AS BIGINT) AS stat_ord,
    CAST(sum(d4) AS DOUBLE) / 4 AS num FROM d WHERE {listed(ONE)} GROUP BY chrom, stat_ord"""
)
def one_sample_h(spark: SparkSession, d: str) -> DataFrame:
    return long(hstats.one_locus(t.sites(spark, d), t.SAMPLES, ["chrom"], two_sample=False), "stat_ord")


@query(h_sql(listed(TWO)))
def two_sample_h(spark: SparkSession, d: str) -> DataFrame:
    return long(hstats.one_locus(t.sites(spark, d), t.SAMPLES, ["chrom"]), "stat_ord").where(F.col("stat_ord").isin(TWO))


def h2_sql(where: str) -> str:
    return f"""WITH {SITES}, {LONG}, {BP}, kept AS (SELECT * FROM d WHERE {where} AND d4 > 0),
    found AS (SELECT l.chrom AS chrom, l.stat_ord AS stat_ord, bin_id, sum(l.d4 * r.d4) AS total FROM kept AS l
              JOIN kept AS r ON l.chrom = r.chrom AND l.stat_ord = r.stat_ord AND r.pos > l.pos AND r.pos < l.pos + 3162
              JOIN bins ON r.pos >= l.pos + bins.lo AND r.pos < l.pos + bins.hi GROUP BY l.chrom, l.stat_ord, bin_id)
    SELECT k.chrom, CAST(k.stat_ord AS BIGINT) AS stat_ord, CAST(b.bin_id AS BIGINT) AS bin_id, CAST(coalesce(f.total, 0) AS DOUBLE) / 16 AS num
    FROM (SELECT DISTINCT chrom, stat_ord FROM d WHERE {where}) AS k CROSS JOIN bins AS b
    LEFT JOIN found AS f ON f.chrom = k.chrom AND f.stat_ord = k.stat_ord AND f.bin_id = b.bin_id"""


@query(h2_sql("true"))
def h2_triangle(spark: SparkSession, d: str) -> DataFrame:
    return long(hstats.two_locus(t.sites(spark, d), t.SAMPLES, t.BP_EDGES, ["chrom"]), "stat_ord", "bin_id")


def many_sql() -> str:
    """All statistics of many samples side by side, as sums of products over pairs, then one a row."""
    alleles = ", ".join(
        f"CAST((o_orderkey*{2 * s + 3} + o_custkey) % 5 < 2 AS INT) AS a{s}, CAST((o_orderkey*{3 * s + 5} + 2*o_custkey) % 7 < 3 AS INT) AS b{s}" for s in range(t.MANY)
    )
    kinds = [(n, f"d{n}") for n, _, _ in hstats.triangle(t.MANY)]
    each = ", ".join(f"{quarter(i, j)} AS d{n}" for n, i, j in hstats.triangle(t.MANY))
    sums = ", ".join(f"CAST(sum(l.{d} * r.{d}) AS DOUBLE) / 16 AS {d}" for _, d in kinds)
    ones = ", ".join(f"CAST(sum({d}) AS DOUBLE) / 4 AS {d}" for _, d in kinds)
    row = f"unnest(range({len(kinds)})) AS stat_ord, unnest([{', '.join(d for _, d in kinds)}]) AS num"
    return f"""WITH s AS (SELECT o_custkey % 4 AS chrom, o_orderkey * 10 + o_custkey % 10 AS pos, {alleles} FROM orders), {BP}, wide AS (SELECT chrom, pos, {each} FROM s),
    h2 AS (SELECT l.chrom AS chrom, bin_id, {sums} FROM wide AS l JOIN wide AS r ON l.chrom = r.chrom AND r.pos > l.pos AND r.pos < l.pos + 3162
           JOIN bins ON r.pos >= l.pos + bins.lo AND r.pos < l.pos + bins.hi GROUP BY l.chrom, bin_id),
    h AS (SELECT chrom, -1 AS bin_id, {ones} FROM wide GROUP BY chrom),
    found AS (SELECT chrom, bin_id, {row} FROM h2 UNION ALL SELECT chrom, bin_id, {row} FROM h)
    SELECT k.chrom, CAST(k.bin_id AS BIGINT) AS bin_id, CAST(k.stat_ord AS BIGINT) AS stat_ord, coalesce(num, 0) AS num
    FROM (SELECT chrom, bin_id, unnest(range({len(kinds)})) AS stat_ord FROM (SELECT DISTINCT chrom FROM s) AS c CROSS JOIN (SELECT bin_id FROM bins UNION ALL SELECT -1) AS b) AS k
    LEFT JOIN found AS f ON f.chrom = k.chrom AND f.bin_id = k.bin_id AND f.stat_ord = k.stat_ord"""


@query(many_sql())
def h2_many_samples(spark: SparkSession, d: str) -> DataFrame:
    """H and H2 of forty samples: 820 statistics, of which only the alleles are shuffled."""
    sites = t.many_samples(spark, d)
    h2 = hstats.two_locus(sites, t.MANY, t.BP_EDGES, ["chrom"])
    h = hstats.one_locus(sites, t.MANY, ["chrom"]).withColumn("bin_id", F.lit(-1))
    return long(h2.unionByName(h), "bin_id", "stat_ord")


@query(h2_sql(listed(ONE)))
def one_sample_h2(spark: SparkSession, d: str) -> DataFrame:
    rows = hstats.two_locus(t.sites(spark, d), t.SAMPLES, t.BP_EDGES, ["chrom"])
    return long(rows, "stat_ord", "bin_id").where(F.col("stat_ord").isin(ONE))


@query(h2_sql(listed(TWO)))
def two_sample_h2(spark: SparkSession, d: str) -> DataFrame:
    rows = hstats.two_locus(t.sites(spark, d), t.SAMPLES, t.BP_EDGES, ["chrom"])
    return long(rows, "stat_ord", "bin_id").where(F.col("stat_ord").isin(TWO))


@query(
    f"""WITH {SITES} SELECT chrom, count(*) AS denom_h, CAST(sum(CASE WHEN u > 3 THEN 1 ELSE 0 END) AS BIGINT) AS fast FROM sites GROUP BY chrom"""
)
def denominator_sites(spark: SparkSession, d: str) -> DataFrame:
    return t.sites(spark, d).groupBy("chrom").agg(F.count("*").alias("denom_h"), F.count_if(F.col("u") > 3).alias("fast"))


@query(
    f"""WITH {SITES}, {BP}, {ENDS}, {MASK}, {merged_sql("m", "mask")},
    c AS (SELECT s.chrom, s.pos FROM sites AS s WHERE EXISTS (SELECT 1 FROM m WHERE m.chrom = s.chrom AND s.pos >= m.lo AND s.pos < m.hi)),
    found AS (SELECT l.chrom AS chrom, bin_id, count(*) AS total FROM c AS l JOIN c AS r ON l.chrom = r.chrom AND r.pos > l.pos AND r.pos < l.pos + 3162
              JOIN bins ON r.pos >= l.pos + bins.lo AND r.pos < l.pos + bins.hi GROUP BY l.chrom, bin_id)
    SELECT k.chrom, CAST(b.bin_id AS BIGINT) AS bin_id, CAST(coalesce(f.total, 0) AS BIGINT) AS denom FROM (SELECT DISTINCT chrom FROM c) AS k
    CROSS JOIN bins AS b LEFT JOIN found AS f ON f.chrom = k.chrom AND f.bin_id = b.bin_id"""
)
def denominator_pairs(spark: SparkSession, d: str) -> DataFrame:
    covered = intervals.in_mask(t.sites(spark, d), t.mask(spark, d), width=4096)
    return long(hstats.pair_denominators(covered, t.BP_EDGES, ["chrom"]), "bin_id")


@query(
    f"""WITH {SITES}, {ENDS}, {MASK}, {merged_sql("m", "mask")}, {BP}, {series("tiles", t.REGION, "k*25000 AS low, least(k*25000 + 25000, stop) AS high, stop, chrom || '_' || k*25000 AS region", 0)},
    w AS (SELECT * FROM tiles WHERE low < high),
    l AS (SELECT w.chrom, region, stop, greatest(lo, low) AS a, least(hi, high) AS b FROM w JOIN m ON m.chrom = w.chrom AND m.lo < w.high AND w.low < m.hi),
    r AS (SELECT m.chrom, lo AS a, least(hi, stop) AS b FROM m JOIN ends ON ends.chrom = m.chrom WHERE lo < stop),
    d AS (SELECT unnest(generate_series(1, 3161)) AS d),
    p AS (SELECT l.chrom, region, d, sum(greatest(0, least(l.b + d, r.b) - greatest(l.a + d, r.a))) AS n FROM l JOIN r ON r.chrom = l.chrom AND r.b > l.a AND r.a < l.b + 3162 CROSS JOIN d GROUP BY l.chrom, region, d)
    SELECT chrom, region, CAST(bin_id AS BIGINT) AS bin_id, CAST(sum(n) AS BIGINT) AS denom FROM p JOIN bins ON d >= bins.lo AND d < bins.hi GROUP BY chrom, region, bin_id
    UNION ALL SELECT chrom, region, CAST(-1 AS BIGINT), CAST(sum(b - a) AS BIGINT) FROM l GROUP BY chrom, region"""
)
def mask_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    """Callable pairs of every tile, from the mask's intervals; the SQL shifts intervals by every distance."""
    windows = region_tiling(spark, d).withColumn("region", t.region_name(F.col("start")))
    return long(pairs.mask_pair_counts(t.mask(spark, d), windows, t.BP_EDGES), "bin_id", "denom")


WINDOWS = f"""windows AS (SELECT chrom, chrom || '_' || k AS region, (k // 2) * {t.REGION} AS start, least((k // 2) * {t.REGION} + (1 + k % 2) * {t.REGION}, stop) AS l_end,
    least((k // 2) * {t.REGION} + (1 + k % 2) * {t.REGION} + 5000, stop) AS r_end FROM ends, (SELECT unnest(generate_series(0, (SELECT max(stop) FROM ends) // {t.REGION} * 2 + 1)) AS k) AS ks
    WHERE (k // 2) * {t.REGION} < stop)"""
MAPPED = "((pos // 4096) * 3 // 4) * 0.5::DOUBLE + (((pos // 4096 + 1) * 3 // 4) - ((pos // 4096) * 3 // 4)) * 0.5::DOUBLE * (pos % 4096) / 4096.0::DOUBLE"


def ranked_sql(edges: list, at: str, rate: str, where: str) -> str:
    """Every covered position is a row here; what lies below an edge is looked up among their running sums."""
    steps = ", ".join(f"({k}, {e!r}::DOUBLE)" for k, e in enumerate(edges))
    return f"""WITH {SITES}, {ENDS}, {MASK}, {merged_sql("m", "mask")}, {STEPS}, {WINDOWS}, edges(edge, e) AS (VALUES {steps}),
    every AS (SELECT chrom, unnest(generate_series(lo, hi - 1)) AS pos FROM m),
    rated AS (SELECT every.chrom, pos, {rate} AS u FROM every {where}),
    placed AS (SELECT chrom, pos, u, CAST({at} AS DOUBLE) AS place, sum(u) OVER (PARTITION BY chrom ORDER BY pos) AS upto FROM rated),
    tops AS (SELECT chrom, place, max(upto) AS upto FROM placed GROUP BY chrom, place),
    w AS (SELECT windows.chrom, region, start, l_end, r_end, placed.upto AS most FROM windows ASOF JOIN placed ON placed.chrom = windows.chrom AND windows.r_end > placed.pos),
    x AS (SELECT w.chrom, region, most, u, upto, place FROM w JOIN placed ON placed.chrom = w.chrom AND pos >= start AND pos < least(l_end, r_end)),
    probes AS (SELECT chrom, region, most, u, upto, edge, place + e AS target FROM x CROSS JOIN edges),
    found AS (SELECT region, edge, sum(u * greatest(least(coalesce(tops.upto, 0), most) - probes.upto, 0)) AS total
              FROM probes ASOF LEFT JOIN tops ON tops.chrom = probes.chrom AND probes.target > tops.place GROUP BY region, edge)
    SELECT region, CAST(a.edge AS BIGINT) AS bin_id, CAST(b.total - a.total AS BIGINT) AS denom FROM found AS a JOIN (SELECT region AS r, edge, total FROM found) AS b ON b.r = a.region AND b.edge = a.edge + 1
    UNION ALL SELECT region, CAST(-1 AS BIGINT), count(*) FROM x GROUP BY region"""


#: In cM: one bin has no width.
INTERVAL_EDGES = [0.0, 0.0009765625, 0.015625, 0.0625, 0.0625, 0.25, 0.375]


@query(ranked_sql(INTERVAL_EDGES, MAPPED, "1", ""))
def mask_pair_counts_cm(spark: SparkSession, d: str) -> DataFrame:
    """Callable pairs by map distance, from intervals: knots lie inside runs, and a quarter of the map is flat.

    Windows overlap, two begin at each place. All map values are binary fractions, which the SQL adds up exactly.
    """
    runs = lattice.weighted_runs(intervals.merge(t.mask(spark, d)))
    sums = lattice.interval_pair_sums(runs, t.overlapping(spark, d), INTERVAL_EDGES, t.flat_map(spark, d), 1 << 16)
    return long(sums, "bin_id").drop("chrom")


ON_STEPS = "JOIN steps ON steps.chrom = every.chrom AND pos >= steps.lo AND pos < steps.hi"


@query(ranked_sql(t.BP_EDGES, "pos", "rate", ON_STEPS))
def rate_pair_sums_steps(spark: SparkSession, d: str) -> DataFrame:
    """Products of mutation rates that are steps with gaps, by base pairs, from intervals."""
    runs = lattice.weighted_runs(intervals.merge(t.mask(spark, d)), t.step_map(spark, d))
    return long(lattice.interval_pair_sums(runs, t.overlapping(spark, d), t.BP_EDGES, width=1 << 16), "bin_id").drop("chrom")


@query(ranked_sql(INTERVAL_EDGES, MAPPED, "rate", ON_STEPS))
def rate_pair_sums_cm(spark: SparkSession, d: str) -> DataFrame:
    """Products of rates by map distance: the denominators of a mutation-weighted run."""
    runs = lattice.weighted_runs(intervals.merge(t.mask(spark, d)), t.step_map(spark, d))
    return long(lattice.interval_pair_sums(runs, t.overlapping(spark, d), INTERVAL_EDGES, t.flat_map(spark, d), 1 << 16), "bin_id").drop("chrom")


@query(
    f"""WITH {SITES}, {ENDS}, {WINDOWS}, {LONG}, {BP}, {EVERY_STATISTIC},
    h AS (SELECT region, stat_ord, CAST(-1 AS BIGINT) AS bin_id, sum(d4) / 4.0 AS num FROM d AS l JOIN windows AS w ON w.chrom = l.chrom AND l.pos >= start AND l.pos < least(l_end, r_end) GROUP BY region, stat_ord),
    kept AS (SELECT * FROM d WHERE d4 > 0),
    pairs AS (SELECT l.chrom AS chrom, l.stat_ord AS stat_ord, l.pos AS x, r.pos AS y, l.d4 * r.d4 AS p, bin_id FROM kept AS l JOIN kept AS r ON l.chrom = r.chrom AND l.stat_ord = r.stat_ord AND r.pos > l.pos AND r.pos < l.pos + 3162
              JOIN bins ON r.pos >= l.pos + bins.lo AND r.pos < l.pos + bins.hi),
    h2 AS (SELECT region, stat_ord, bin_id, sum(p) / 16.0 AS num FROM pairs JOIN windows AS w ON w.chrom = pairs.chrom AND x >= start AND x < l_end AND y < r_end GROUP BY region, stat_ord, bin_id),
    nums AS (SELECT * FROM h UNION ALL SELECT * FROM h2), near AS (SELECT l.chrom AS chrom, l.pos AS x, r.pos AS y, bin_id FROM sites AS l JOIN sites AS r ON l.chrom = r.chrom AND r.pos > l.pos AND r.pos < l.pos + 3162
              JOIN bins ON r.pos >= l.pos + bins.lo AND r.pos < l.pos + bins.hi),
    denoms AS (SELECT region, CAST(-1 AS BIGINT) AS bin_id, count(*) AS denom FROM sites AS l JOIN windows AS w ON w.chrom = l.chrom AND l.pos >= start AND l.pos < least(l_end, r_end) GROUP BY region
              UNION ALL SELECT region, bin_id, count(*) FROM near JOIN windows AS w ON w.chrom = near.chrom AND x >= start AND x < l_end AND y < r_end GROUP BY region, bin_id)
    SELECT w.region, CAST(b.bin_id AS BIGINT) AS bin_id, CAST(s.stat_ord AS BIGINT) AS stat_ord, CAST(coalesce(num, 0) AS DOUBLE) AS num, CAST(coalesce(denom, 0) AS DOUBLE) AS denom
    FROM windows AS w CROSS JOIN stats AS s CROSS JOIN (SELECT CAST(-1 AS BIGINT) AS bin_id UNION ALL SELECT bin_id FROM bins) AS b
    LEFT JOIN nums ON nums.region = w.region AND nums.stat_ord = s.stat_ord AND nums.bin_id = b.bin_id LEFT JOIN denoms ON denoms.region = w.region AND denoms.bin_id = b.bin_id"""
)
def compute_h2_windows(spark: SparkSession, d: str) -> DataFrame:
    """Windows that overlap, two from each start, each with its own right end; all sites are callable."""
    windows, sites = t.overlapping(spark, d), t.sites(spark, d)
    rows = hstats.window_statistics(sites, windows, t.SAMPLES, t.BP_EDGES, hstats.window_denominators(sites, windows, t.BP_EDGES))
    return long(rows, "bin_id", "stat_ord").select("region", "bin_id", "stat_ord", "num", "denom")


@query(
    f"""WITH {SITES} SELECT l.chrom AS chrom, round(avg(l.u * r.u), 8) AS mean_mut_prod FROM sites AS l JOIN sites AS r
    ON l.chrom = r.chrom AND r.pos > l.pos GROUP BY l.chrom"""
)
def mean_mut_prod(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs.mean_product(t.sites(spark, d).withColumn("u", F.col("u").cast("double")), ["chrom"], "u")
    return rows.select("chrom", F.round("mean_mut_prod", 8).alias("mean_mut_prod"))


@query(
    f"""WITH {SITES}, n AS (SELECT l.chrom AS chrom, count(*) AS num_pairs FROM sites AS l JOIN sites AS r ON l.chrom = r.chrom
          AND r.pos > l.pos AND r.pos < l.pos + 3162 GROUP BY l.chrom)
    SELECT s.chrom, count(*) AS num_sites, round(avg(s.u), 9) AS mean_mut, round(avg(s.u) * avg(s.u), 9) AS sqr_mean_mut, max(n.num_pairs) AS num_pairs
    FROM sites AS s JOIN n ON n.chrom = s.chrom GROUP BY s.chrom"""
)
def mut_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = hstats.mutation_stats(t.sites(spark, d).withColumn("u", F.col("u").cast("double")), t.BP_EDGES, ["chrom"], "u")
    return rows.select("chrom", "num_sites", F.round("mean_mut", 9).alias("mean_mut"), F.round("sqr_mean_mut", 9).alias("sqr_mean_mut"), "num_pairs")


def ratio_sql(denom: str, mean: str) -> str:
    return f"""WITH {SITES}, {BP}, {LONG}, e AS (SELECT chrom, avg(u) * avg(u) AS m2 FROM sites GROUP BY chrom),
    nums AS (SELECT l.chrom AS chrom, l.stat_ord AS stat_ord, bin_id, sum(l.d4 * r.d4) / 16.0 AS num FROM d AS l
             JOIN d AS r ON l.chrom = r.chrom AND l.stat_ord = r.stat_ord AND r.pos > l.pos AND r.pos < l.pos + 3162
             JOIN bins ON r.pos >= l.pos + bins.lo AND r.pos < l.pos + bins.hi WHERE l.d4 > 0 AND r.d4 > 0 GROUP BY l.chrom, l.stat_ord, bin_id),
    denoms AS (SELECT l.chrom AS chrom, bin_id, sum({denom}) AS denom FROM sites AS l JOIN sites AS r ON l.chrom = r.chrom AND r.pos > l.pos AND r.pos < l.pos + 3162
             JOIN bins ON r.pos >= l.pos + bins.lo AND r.pos < l.pos + bins.hi GROUP BY l.chrom, bin_id)
    SELECT k.chrom, CAST(k.stat_ord AS BIGINT) AS stat_ord, CAST(b.bin_id AS BIGINT) AS bin_id, round(coalesce(num, 0) / nullif({mean}, 0), 9) AS mean
    FROM (SELECT DISTINCT chrom, stat_ord FROM d) AS k CROSS JOIN bins AS b JOIN e ON e.chrom = k.chrom
    LEFT JOIN nums ON nums.chrom = k.chrom AND nums.stat_ord = k.stat_ord AND nums.bin_id = b.bin_id
    LEFT JOIN denoms ON denoms.chrom = k.chrom AND denoms.bin_id = b.bin_id"""


def h2_means(spark: SparkSession, d: str, rate: str | None, factor: bool) -> DataFrame:
    sites = t.sites(spark, d)
    nums = hstats.two_locus(sites, t.SAMPLES, t.BP_EDGES, ["chrom"])
    denoms = hstats.pair_denominators(sites, t.BP_EDGES, ["chrom"], rate=rate)
    if factor:
        m = sites.groupBy("chrom").agg((F.avg("u") * F.avg("u")).alias("m2"))
        denoms = denoms.join(F.broadcast(m), "chrom").withColumn("denom", F.col("denom") / F.col("m2"))  # a row a chromosome
    rows = hstats.means(nums, denoms.select("chrom", "bin_id", "denom"), ["chrom", "bin_id"])
    return long(rows, "stat_ord", "bin_id").select("chrom", "stat_ord", "bin_id", F.round("mean", 9).alias("mean"))


@query(ratio_sql("1", "denom"))
def ratio_means_snp(spark: SparkSession, d: str) -> DataFrame:
    return h2_means(spark, d, None, False)


@query(ratio_sql("l.u * r.u", "denom / e.m2"))
def ratio_means_mut_weighted(spark: SparkSession, d: str) -> DataFrame:
    return h2_means(spark, d, "u", True)


# Regions and bootstrap

TILES = series("tiles", t.REGION, "chrom || '_' || k AS region", 1)
EVERY = EVERY_STATISTIC


def regional_sql(of: str, same: str = "true") -> str:
    """Sums and denominators of every tile, statistic and row, whether or not it has a pair.

    ``of`` names the tile of a site; ``same`` is what else two sites of a pair must share.
    """
    on = f"l.chrom = r.chrom AND {same} AND r.pos > l.pos AND r.pos < l.pos + 3162"
    in_bin = "r.pos >= l.pos + bins.lo AND r.pos < l.pos + bins.hi"
    return f"""h AS (SELECT {of.format("l")} AS region, stat_ord, CAST(-1 AS BIGINT) AS row, sum(d4) / 4.0 AS num FROM d AS l GROUP BY 1, 2),
    h2 AS (SELECT {of.format("l")} AS region, l.stat_ord AS stat_ord, bin_id AS row, sum(l.d4 * r.d4) / 16.0 AS num FROM d AS l JOIN d AS r ON {on} AND l.stat_ord = r.stat_ord
           JOIN bins ON {in_bin} WHERE l.d4 > 0 AND r.d4 > 0 GROUP BY 1, 2, 3),
    n1 AS (SELECT {of.format("l")} AS region, CAST(-1 AS BIGINT) AS row, count(*) AS denom FROM sites AS l GROUP BY 1),
    n2 AS (SELECT {of.format("l")} AS region, bin_id AS row, sum(l.u * r.u) AS denom FROM sites AS l JOIN sites AS r ON {on} JOIN bins ON {in_bin} GROUP BY 1, 2),
    nums AS (SELECT region, stat_ord, row, num FROM h UNION ALL SELECT region, stat_ord, row, num FROM h2), denoms AS (SELECT region, row, denom FROM n1 UNION ALL SELECT region, row, denom FROM n2),
    regional AS (SELECT tiles.region, b.row, s.stat_ord, coalesce(num, 0) AS num, CAST(coalesce(denom, 0) AS DOUBLE) AS denom
      FROM tiles CROSS JOIN stats AS s CROSS JOIN (SELECT CAST(-1 AS BIGINT) AS row UNION ALL SELECT bin_id FROM bins) AS b
      LEFT JOIN nums ON nums.region = tiles.region AND nums.stat_ord = s.stat_ord AND nums.row = b.row LEFT JOIN denoms ON denoms.region = tiles.region AND denoms.row = b.row)"""


REGIONS = regional_sql("{0}.chrom || '_' || ({0}.pos // " + str(t.REGION) + ")")
RATES = f"rates AS (SELECT chrom || '_' || (pos // {t.REGION}) AS region, count(*) AS num_sites, avg(u) AS mean_mut FROM sites GROUP BY chrom, pos // {t.REGION})"
FACTOR = "factor AS (SELECT (sum(num_sites * mean_mut) / sum(num_sites)) * (sum(num_sites * mean_mut) / sum(num_sites)) AS f FROM rates)"
BASE = f"WITH {SITES}, {ENDS}, {TILES}, {EVERY}, {LONG}, {BP}, {REGIONS}, {RATES}, {FACTOR}"
REPS, SEED = 40, 5


def region_table(spark: SparkSession, d: str) -> DataFrame:
    sites = t.regions(spark, d)
    rows = hstats.region_statistics(sites, sites, t.SAMPLES, t.BP_EDGES, rate="u", regions=t.tiles(spark, d))
    # Resampling reads the regions' rows more than once.
    return written(region_rows(rows), "regions")


def region_rows(rows: DataFrame) -> DataFrame:
    return rows.select("region", F.col("bin_id").cast("long").alias("row"), F.col("stat_ord").cast("long").alias("stat_ord"), "num", "denom")


def region_rates(spark: SparkSession, d: str) -> DataFrame:
    return hstats.region_rates(t.regions(spark, d), "u", t.tiles(spark, d))


@query(BASE + " SELECT region, row, CAST(stat_ord AS BIGINT) AS stat_ord, round(num, 6) AS num, round(denom, 6) AS denom FROM regional")
def compute_h2(spark: SparkSession, d: str) -> DataFrame:
    return region_table(spark, d).withColumns({c: F.round(c, 6) for c in ("num", "denom")})


ARMS = f"""arm AS (SELECT chrom, 0 AS low, stop // 2 AS high FROM ends UNION ALL SELECT chrom, stop // 2, stop + {t.REGION} FROM ends),
    tiles AS (SELECT arm.chrom || '_' || (low + k * {t.REGION}) AS region FROM arm, (SELECT unnest(generate_series(0, (SELECT max(stop) FROM ends) // {t.REGION} + 1)) AS k) AS ks
              WHERE low + k * {t.REGION} < high)"""
IN_ARM = regional_sql(
    "{0}.chrom || '_' || (CASE WHEN {0}.pos < {0}.mid THEN {0}.pos // " + f"{t.REGION} * {t.REGION} " + "ELSE {0}.mid + ({0}.pos - {0}.mid) // " + f"{t.REGION} * {t.REGION}" + " END)",
    "(l.pos < l.mid) = (r.pos < r.mid)",
)


BY_ARM = f"""WITH ends AS (SELECT o_custkey % 4 AS chrom, max(o_orderkey * 10 + o_custkey % 10) + 1 AS stop FROM orders GROUP BY 1),
    {SITES.replace("sites AS (", "plain AS (")}, sites AS (SELECT plain.*, stop // 2 AS mid FROM plain JOIN ends ON ends.chrom = plain.chrom),
    {ARMS}, {EVERY}, {LONG.replace("SELECT chrom, pos, u,", "SELECT chrom, pos, u, mid,")}, {BP}, {IN_ARM}"""


@query(
    f"""{BY_ARM} SELECT region, row, CAST(stat_ord AS BIGINT) AS stat_ord, round(num, 6) AS num, round(denom, 6) AS denom FROM regional"""
)
def compute_h2_arms(spark: SparkSession, d: str) -> DataFrame:
    """Tiles of two arms: no pair reaches over the centromere, and tiles without sites have rows too."""
    return arm_table(spark, d).withColumns({c: F.round(c, 6) for c in ("num", "denom")})


def arm_table(spark: SparkSession, d: str) -> DataFrame:
    windows = t.arms(spark, d).withColumn("region", t.region_name(F.col("start")))
    tiled = intervals.locate(t.sites(spark, d), windows.select("chrom", "start", F.col("l_end").alias("end"), "r_end", "region"))
    rows = hstats.region_statistics(tiled, tiled, t.SAMPLES, t.BP_EDGES, rate="u", by=["chrom", "r_end"], regions=windows)
    return region_rows(rows)


@query(
    f"""{BY_ARM}, of_arm AS (SELECT arm.chrom || '_' || (low + k * {t.REGION}) AS region, CASE WHEN low = 0 THEN 'p' ELSE 'q' END AS arm
      FROM arm, (SELECT unnest(generate_series(0, (SELECT max(stop) FROM ends) // {t.REGION} + 1)) AS k) AS ks WHERE low + k * {t.REGION} < high),
    each AS (SELECT arm, row, stat_ord, num, denom FROM regional JOIN of_arm ON of_arm.region = regional.region UNION ALL SELECT 'total', row, stat_ord, num, denom FROM regional),
    m AS (SELECT arm, row, stat_ord, sum(num) / nullif(sum(denom), 0) AS mean FROM each GROUP BY arm, row, stat_ord)
    SELECT a.arm, a.row, CAST(a.stat_ord AS BIGINT) AS stat_ord, round(a.mean, 9) AS mean, round(h.mean * h.mean, 9) AS h_squared
    FROM m AS a JOIN m AS h ON h.arm = a.arm AND h.stat_ord = a.stat_ord AND h.row = -1 WHERE a.row >= 0"""
)
def arm_means(spark: SparkSession, d: str) -> DataFrame:
    """H2 of the two arms and of both, beside the squares of H."""
    arm = F.when(F.col("start") < F.col("middle"), "p").otherwise("q").alias("arm")
    named = t.arms(spark, d).join(F.broadcast(t.middles(spark, d)), F.col("chrom") == F.col("of"))  # a row a chromosome
    named = named.select(t.region_name(F.col("start")).alias("region"), arm)
    rows = views.arm_means(arm_table(spark, d).join(named, "region"))
    return rows.withColumns({c: F.round(c, 9) for c in ("mean", "h_squared")})


@query(BASE + " SELECT row, CAST(stat_ord AS BIGINT) AS stat_ord, round(sum(num) / nullif(sum(denom), 0), 9) AS mean FROM regional GROUP BY row, stat_ord")
def region_means(spark: SparkSession, d: str) -> DataFrame:
    return boot.region_means(region_table(spark, d)).withColumn("mean", F.round("mean", 9))


SCALED = "CASE WHEN row = -1 THEN denom ELSE denom / f END"


@query(
    BASE + f" SELECT row, CAST(stat_ord AS BIGINT) AS stat_ord, round(sum(num) / nullif(sum({SCALED}), 0), 9) AS mean FROM regional, factor GROUP BY row, stat_ord"
)
def region_means_mut(spark: SparkSession, d: str) -> DataFrame:
    return boot.region_means(region_table(spark, d), region_rates(spark, d)).withColumn("mean", F.round("mean", 9))


BOOT = f"""{BASE}, numbered AS (SELECT region, row_number() OVER (ORDER BY region) - 1 AS region_ord FROM (SELECT DISTINCT region FROM regional) AS x),
    drawn AS (SELECT rep, CAST('0x' || substr(md5('{SEED}:' || rep || ':' || draw), 1, 15) AS BIGINT) % (SELECT count(*) FROM numbered) AS region_ord
      FROM (SELECT unnest(generate_series(0, {REPS - 1})) AS rep) AS a, (SELECT unnest(generate_series(0, (SELECT count(*) FROM numbered) - 1)) AS draw) AS b),
    reps AS (SELECT rep, row, stat_ord, sum(num) / nullif(sum(DENOM), 0) AS value FROM drawn JOIN numbered ON numbered.region_ord = drawn.region_ord
      JOIN regional ON regional.region = numbered.region, factor GROUP BY rep, row, stat_ord)"""
COV = """ SELECT a.row AS row, CAST(a.stat_ord AS BIGINT) AS stat_i, CAST(b.stat_ord AS BIGINT) AS stat_j, round(covar_samp(a.value, b.value), 9) + 0.0 AS cov
    FROM reps AS a JOIN reps AS b ON a.rep = b.rep AND a.row = b.row GROUP BY a.row, a.stat_ord, b.stat_ord"""


@query(BOOT.replace("DENOM", "denom") + " SELECT rep, row, CAST(stat_ord AS BIGINT) AS stat_ord, round(value, 9) AS value FROM reps")
def bootstrap_means(spark: SparkSession, d: str) -> DataFrame:
    return boot.replicates(region_table(spark, d), REPS, seed=SEED).withColumn("value", F.round("value", 9))


@query(BOOT.replace("DENOM", "denom") + COV)
def bootstrap_cov(spark: SparkSession, d: str) -> DataFrame:
    reps = boot.replicates(region_table(spark, d), REPS, seed=SEED)
    return boot.covariances(reps).withColumn("cov", F.round("cov", 9) + 0.0)


@query(BOOT.replace("DENOM", SCALED) + COV)
def bootstrap_cov_mut(spark: SparkSession, d: str) -> DataFrame:
    reps = boot.replicates(region_table(spark, d), REPS, rates=region_rates(spark, d), seed=SEED)
    return boot.covariances(reps).withColumn("cov", F.round("cov", 9) + 0.0)


@query(
    BOOT.replace("DENOM", "denom")
    + """ SELECT a.row AS row, CAST(CASE a.stat_ord WHEN 4 THEN 0 ELSE 1 END AS BIGINT) AS stat_i, CAST(CASE b.stat_ord WHEN 4 THEN 0 ELSE 1 END AS BIGINT) AS stat_j,
    round(covar_samp(a.value, b.value), 9) + 0.0 AS cov FROM reps AS a JOIN reps AS b ON a.rep = b.rep AND a.row = b.row
    WHERE a.stat_ord IN (0, 4) AND b.stat_ord IN (0, 4) GROUP BY a.row, a.stat_ord, b.stat_ord"""
)
def cov_submatrix(spark: SparkSession, d: str) -> DataFrame:
    reps = boot.replicates(region_table(spark, d), REPS, seed=SEED)
    cov = boot.subset_statistics(boot.covariances(reps), [4, 0])
    return long(cov, "stat_i", "stat_j").withColumn("cov", F.round("cov", 9) + 0.0)


@query(
    BASE + " SELECT row, CAST(stat_ord AS BIGINT) AS stat_ord, round(sum(num) / nullif(sum(denom), 0), 9) AS mean FROM regional WHERE row IN (-1, 2, 3, 4) GROUP BY row, stat_ord"
)
def bin_subset(spark: SparkSession, d: str) -> DataFrame:
    kept = boot.subset_bins(region_table(spark, d), t.BP_EDGES, 32, 1000)
    return boot.region_means(kept).withColumn("mean", F.round("mean", 9))


#: Forward elimination, a row and column at a time, of covariances with the differences beside them.
ELIMINATED = f"""WITH RECURSIVE {BOOT.removeprefix("WITH ").replace("DENOM", "denom")},
    found AS (SELECT row, stat_ord, avg(value) AS mean FROM reps GROUP BY row, stat_ord),
    c AS (SELECT a.row AS row, a.stat_ord AS i, b.stat_ord AS j, covar_samp(a.value, b.value) AS cov FROM reps AS a JOIN reps AS b ON a.rep = b.rep AND a.row = b.row GROUP BY a.row, a.stat_ord, b.stat_ord),
    lines AS (SELECT c.row, i, list_append(list(cov ORDER BY j), max(0.5 * mean)) AS line FROM c JOIN found ON found.row = c.row AND found.stat_ord = c.i GROUP BY c.row, i),
    step AS (SELECT row, list(line ORDER BY i) AS m, 0.0::DOUBLE AS ll FROM lines GROUP BY row
      UNION ALL SELECT row, list_transform(m[2:], lambda r: list_transform(range(2, len(r) + 1), lambda k: r[k] - r[1] / m[1][1] * m[1][k])), ll - m[1][len(m[1])] * m[1][len(m[1])] / m[1][1] FROM step WHERE len(m) > 0),
    ll AS (SELECT row, ll FROM step WHERE len(m) = 0)"""


def all_bins(spark: SparkSession, d: str) -> DataFrame:
    """Likelihoods of the mean replicate under half of it, over all statistics."""
    reps = written(boot.replicates(region_table(spark, d), REPS, seed=SEED), "replicates")
    data = reps.groupBy("row", "stat_ord").agg(F.avg("value").alias("mean"))
    return likelihood.bin_likelihoods(data, data.withColumn("mean", F.col("mean") * 0.5), boot.covariances(reps))


@query(ELIMINATED + " SELECT row, round(ll, 3) AS ll FROM ll")
def gaussian_bin_ll(spark: SparkSession, d: str) -> DataFrame:
    return all_bins(spark, d).withColumn("ll", F.round("ll", 3))


@query(ELIMINATED + " SELECT round(sum(CASE WHEN row >= 0 THEN ll END), 2) AS ll, round(sum(ll), 2) AS ll_with_h FROM ll")
def gaussian_total_ll(spark: SparkSession, d: str) -> DataFrame:
    bins = written(all_bins(spark, d), "likelihoods")
    whole = likelihood.total_likelihood(bins, True).withColumnRenamed("ll", "ll_with_h")
    return likelihood.total_likelihood(bins).crossJoin(F.broadcast(whole)).select(F.round("ll", 2).alias("ll"), F.round("ll_with_h", 2).alias("ll_with_h"))  # one row each


@query(
    f"""WITH {SITES}, {LONG} SELECT chrom, CAST(CASE stat_ord WHEN 7 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS BIGINT) AS stat_ord, sum(d4) / 4.0 AS num
    FROM d WHERE stat_ord IN (7, 5, 4) GROUP BY chrom, stat_ord"""
)
def pop_subset(spark: SparkSession, d: str) -> DataFrame:
    sites = hstats.select_populations(t.sites(spark, d), t.POPULATIONS, [("P2", "x"), ("P1", "y")])
    return long(hstats.one_locus(sites, 2, ["chrom"]), "stat_ord")


# Intervals and maps


@query(f"WITH {SITES}, {ENDS}, {MASK}, {merged_sql('m', 'mask')} SELECT chrom, lo AS start, hi AS \"end\" FROM m")
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge(t.mask(spark, d))


@query(
    f"""WITH {SITES}, {ENDS}, {MASK}, {MASK2}, {merged_sql("m", "mask")}, {merged_sql("n", "mask2")}
    SELECT m.chrom, greatest(m.lo, n.lo) AS start, least(m.hi, n.hi) AS "end" FROM m JOIN n ON m.chrom = n.chrom AND m.lo < n.hi AND n.lo < m.hi"""
)
def interval_intersect(spark: SparkSession, d: str) -> DataFrame:
    return intervals.intersect(t.mask(spark, d), t.second_mask(spark, d))


@query(
    """WITH p AS (SELECT DISTINCT o_custkey % 4 AS chrom, CAST(floor(o_totalprice / 10) AS BIGINT) AS pos FROM orders),
    q AS (SELECT chrom, pos, pos - row_number() OVER (PARTITION BY chrom ORDER BY pos) AS island FROM p)
    SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end" FROM q GROUP BY chrom, island"""
)
def coverage_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "orders").select((F.col("o_custkey") % 4).alias("chrom"), F.floor(F.col("o_totalprice") / 10).alias("pos"))
    return intervals.runs(rows, width=1000)


@query(
    f"""WITH {SITES}, {ENDS}, {MASK}, {merged_sql("m", "mask")},
    k AS (SELECT m.chrom, greatest(lo, stop // 4) AS lo, least(hi, stop // 2) AS hi FROM m JOIN ends ON ends.chrom = m.chrom WHERE lo < stop // 2 AND hi > stop // 4)
    SELECT chrom, pos FROM (SELECT chrom, lo, hi, unnest(generate_series(lo, hi - 1)) AS pos FROM k) AS x"""
)
def positions_in_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The second quarter of each chromosome: clipping is the feature."""
    ends = t.last_position(spark, d).select(F.col("chrom").alias("of"), F.col("end").alias("stop"))
    merged = intervals.merge(t.mask(spark, d)).join(F.broadcast(ends), F.col("chrom") == F.col("of"))  # a row a chromosome
    clipped = intervals.clip(merged, F.floor(F.col("stop") / 4), F.floor(F.col("stop") / 2))
    return intervals.positions(clipped.select("chrom", "start", "end"))


@query(
    f"""WITH {SITES}, {ENDS}, {MASK} SELECT s.chrom, s.pos FROM sites AS s WHERE EXISTS (SELECT 1 FROM mask WHERE mask.chrom = s.chrom AND s.pos >= mask.lo AND s.pos < mask.hi)"""
)
def mask_semijoin(spark: SparkSession, d: str) -> DataFrame:
    return intervals.in_mask(t.sites(spark, d).select("chrom", "pos"), t.mask(spark, d), width=4096)


@query(
    f"""WITH {SITES}, {ENDS}, {MASK}, {merged_sql("m", "mask")} SELECT chrom, lo AS start, hi AS "end" FROM m WHERE hi - lo > 700"""
)
def long_intervals(spark: SparkSession, d: str) -> DataFrame:
    return intervals.longer_than(intervals.merge(t.mask(spark, d)), 700)


@query(
    f"""WITH {SITES}, k AS (SELECT chrom, pos, pos // 5000 AS k FROM sites) SELECT chrom, pos,
    round(k*0.5 + (k % 3)*0.125 + (((k+1)*0.5 + ((k+1) % 3)*0.125) - (k*0.5 + (k % 3)*0.125)) * (pos - k*5000) / 5000.0, 9) AS cm FROM k"""
)
def rec_map_interp(spark: SparkSession, d: str) -> DataFrame:
    knots = maps.checked_map(t.rec_map(spark, d))
    return maps.interpolate(t.sites(spark, d).select("chrom", "pos"), knots).withColumn("cm", F.round("cm", 9))


@query(
    f"""WITH {SITES}, {ENDS}, {STEPS} SELECT s.chrom, s.pos, steps.rate AS u FROM sites AS s LEFT JOIN steps
    ON steps.chrom = s.chrom AND s.pos >= steps.lo AND s.pos < steps.hi"""
)
def mut_map_step(spark: SparkSession, d: str) -> DataFrame:
    return maps.step_lookup(t.sites(spark, d).select("chrom", "pos"), t.step_map(spark, d))


@query(f"WITH {SITES} SELECT chrom, pos, u FROM sites")
def mut_map_gather(spark: SparkSession, d: str) -> DataFrame:
    sites = t.sites(spark, d)
    return maps.gather(sites.select("chrom", "pos"), sites.select("chrom", "pos", F.col("u").cast("double").alias("u"))).withColumn("u", F.col("u").cast("long"))


FRACTION = "(1 + l_partkey % 400) / 1000.0"


@query(f"SELECT l_partkey, round(-50 * ln(1 - 2 * {FRACTION}), 9) AS cm FROM lineitem")
def haldane(spark: SparkSession, d: str) -> DataFrame:
    r = (1 + F.col("l_partkey") % 400) / 1000.0
    return t.table(spark, d, "lineitem").select("l_partkey", F.round(g.haldane(r), 9).alias("cm"))


@query("SELECT l_partkey, round((1 - exp(-(l_partkey % 90) / 50.0)) / 2, 9) AS r FROM lineitem")
def haldane_inverse(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "lineitem").select("l_partkey", F.round(g.inverse_haldane((F.col("l_partkey") % 90).cast("double")), 9).alias("r"))


@query(f"WITH {SITES} SELECT chrom, CAST(count(*) * (count(*) - 1) // 2 AS BIGINT) AS site_pairs FROM sites GROUP BY chrom")
def site_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = t.sites(spark, d).groupBy("chrom").agg(F.count("*").alias("n"))
    return n.select("chrom", g.n_choose_2(F.col("n")).alias("site_pairs"))


@query(
    f"""WITH {SITES}, {ENDS}, {series("tiles", t.REGION, "k*25000 AS start, stop", 0)}
    SELECT chrom, start, least(start + 25000, stop) AS l_end, stop AS r_end FROM tiles WHERE start < stop"""
)
def region_tiling(spark: SparkSession, d: str) -> DataFrame:
    ends = t.last_position(spark, d).select("chrom", F.lit(0).cast("long").alias("start"), "end")
    return intervals.segments(ends, t.REGION)


BANDS = """bands AS (SELECT CAST(11 + o_custkey % 4 AS VARCHAR) AS chrom, (o_orderkey % 97) * 1000 AS start, (o_orderkey % 97 + 1) * 1000 AS stop,
    CASE WHEN o_orderkey % 97 < 40 THEN 'p1' ELSE 'q1' END AS band FROM orders)"""


@query(
    f"""WITH {BANDS}, e AS (SELECT chrom, max(stop) AS stop, max(CASE WHEN band LIKE 'p%' THEN stop END) AS cen FROM bands GROUP BY chrom)
    SELECT chrom, CAST(0 AS BIGINT) AS start, stop AS l_end, stop AS r_end FROM e WHERE chrom IN ('13', '14', '15', '21', '22')
    UNION ALL SELECT chrom, CAST(0 AS BIGINT), cen, cen FROM e WHERE chrom NOT IN ('13', '14', '15', '21', '22')
    UNION ALL SELECT chrom, cen, stop, stop FROM e WHERE chrom NOT IN ('13', '14', '15', '21', '22')"""
)
def arm_windows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 97
    bands = t.table(spark, d, "orders").select(
        (11 + F.col("o_custkey") % 4).cast("string").alias("chrom"), (k * 1000).alias("start"), ((k + 1) * 1000).alias("end"),
        F.when(k < 40, "p1").otherwise("q1").alias("band"),
    )
    return intervals.chromosome_arms(bands)


# Quadrature and views


@query(
    f"""WITH {SITES}, v AS (SELECT chrom, pos // 5000 AS point, CAST(sum(u) AS DOUBLE) AS value FROM sites GROUP BY chrom, pos // 5000)
    SELECT chrom, point AS bin_id, (value + after) / 2 AS value FROM (SELECT chrom, point, value, lead(value) OVER (PARTITION BY chrom ORDER BY point) AS after FROM v) AS x WHERE after IS NOT NULL"""
)
def quadrature_trapezoid(spark: SparkSession, d: str) -> DataFrame:
    return quadrature.integrate(point_values(spark, d), "trapezoid", ["chrom"])


@query(
    f"""WITH {SITES}, v AS (SELECT chrom, pos // 5000 AS point, CAST(sum(u) AS DOUBLE) AS value FROM sites GROUP BY chrom, pos // 5000)
    SELECT chrom, CAST(point // 2 AS BIGINT) AS bin_id, round(value / 6 + a * 2 / 3 + b / 6, 9) AS value FROM (SELECT chrom, point, value, lead(value, 1) OVER (PARTITION BY chrom ORDER BY point) AS a,
      lead(value, 2) OVER (PARTITION BY chrom ORDER BY point) AS b FROM v) AS x WHERE b IS NOT NULL AND point % 2 = 0"""
)
def quadrature_simpson(spark: SparkSession, d: str) -> DataFrame:
    rows = quadrature.integrate(point_values(spark, d), "simpson", ["chrom"])
    return long(rows, "bin_id").withColumn("value", F.round("value", 9))


def point_values(spark: SparkSession, d: str) -> DataFrame:
    return t.sites(spark, d).groupBy("chrom", F.floor(F.col("pos") / 5000).alias("point")).agg(F.sum("u").cast("double").alias("value"))


@query(
    """SELECT 'l_quantity' AS param_i, 'l_extendedprice' AS param_j, round(corr(l_quantity, l_extendedprice), 9) AS rho FROM lineitem WHERE l_tax >= 0.02
    UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 9) FROM lineitem WHERE l_tax >= 0.02
    UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 9) FROM lineitem WHERE l_tax >= 0.02"""
)
def param_corr(spark: SparkSession, d: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    return views.parameter_correlations(t.table(spark, d, "lineitem"), names, "l_tax", 0.02).withColumn("rho", F.round("rho", 9))


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS param_i, '{b}' AS param_j, CAST({a} AS DOUBLE) AS value_i, CAST({b} AS DOUBLE) AS value_j, l_tax FROM lineitem WHERE l_tax >= 0.02"
        for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))
    )
)
def param_pairs(spark: SparkSession, d: str) -> DataFrame:
    return views.parameter_pairs(t.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], "l_tax", 0.02)


@query(
    """WITH b AS (SELECT CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 0 WHEN l_quantity >= 10 AND l_quantity < 25 THEN 1 WHEN l_quantity >= 25 AND l_quantity <= 50 THEN 2 END AS bin_id FROM lineitem)
    SELECT CAST(bin_id AS BIGINT) AS bin_id, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM b WHERE bin_id IS NOT NULL), 9) AS freq FROM b WHERE bin_id IS NOT NULL GROUP BY bin_id"""
)
def histogram_freq(spark: SparkSession, d: str) -> DataFrame:
    rows = views.histogram(t.table(spark, d, "lineitem"), "l_quantity", [0, 10, 25, 50])
    return long(rows, "bin_id").withColumn("freq", F.round("freq", 9))


@query(
    """SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
    round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY o_orderstatus"""
)
def box_quantiles(spark: SparkSession, d: str) -> DataFrame:
    rows = views.quartiles(t.table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice")
    return rows.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query(
    f"""SELECT o_orderstatus AS name, round(avg(o_totalprice), 4) AS value, round(avg(o_totalprice) - {g.normal_quantile(0.95)!r} * stddev_samp(o_totalprice), 4) AS low,
    round(avg(o_totalprice) + {g.normal_quantile(0.95)!r} * stddev_samp(o_totalprice), 4) AS high FROM orders GROUP BY o_orderstatus"""
)
def ci_table(spark: SparkSession, d: str) -> DataFrame:
    rows = t.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(
        F.avg("o_totalprice").alias("value"), F.stddev_samp("o_totalprice").alias("se")
    )
    out = views.intervals(rows).drop("se")
    return out.withColumns({c: F.round(c, 4) for c in ("value", "low", "high")})


@query(
    f"""WITH {SITES}, {ENDS}, h AS (SELECT sites.chrom, CASE WHEN pos < stop // 2 THEN 'p' ELSE 'q' END AS arm, avg(CAST(u AS DOUBLE)) AS mean FROM sites JOIN ends ON ends.chrom = sites.chrom GROUP BY 1, 2)
    SELECT chrom, round(max(CASE WHEN arm = 'p' THEN mean END), 9) AS left_h, round(max(CASE WHEN arm = 'q' THEN mean END), 9) AS right_h,
    round(max(CASE WHEN arm = 'p' THEN mean END) * max(CASE WHEN arm = 'q' THEN mean END), 9) AS "cross" FROM h GROUP BY chrom"""
)
def cross_arm(spark: SparkSession, d: str) -> DataFrame:
    rows = t.sites(spark, d).join(F.broadcast(t.middles(spark, d)), F.col("chrom") == F.col("of"))  # a row a chromosome
    rows = rows.groupBy("chrom", F.when(F.col("pos") < F.col("middle"), "p").otherwise("q").alias("arm")).agg(F.avg("u").alias("mean"))
    return views.cross_product(rows, ["chrom"], "p", "q").withColumns({c: F.round(c, 9) for c in ("left_h", "right_h", "cross")})


@query(
    f"""WITH {SITES}, {LONG}, l(stat_ord, label) AS (VALUES {", ".join(f"({n}, '{f'P{i}' if i == j else f'P{i}-P{j}'}')" for n, i, j in TRIANGLE)})
    SELECT chrom, label, CAST(sum(d4) AS DOUBLE) / 4 AS num FROM d JOIN l ON l.stat_ord = d.stat_ord GROUP BY chrom, label"""
)
def stat_labels(spark: SparkSession, d: str) -> DataFrame:
    names = F.broadcast(hstats.labels(spark, t.POPULATIONS))  # a row a statistic
    rows = hstats.one_locus(t.sites(spark, d), t.SAMPLES, ["chrom"]).join(names, "stat_ord")
    return rows.select("chrom", g.stat_label(F.col("pop_i"), F.col("pop_j")).alias("label"), "num")


def table_statistics(spark: SparkSession, d: str) -> Statistics:
    rows = region_table(spark, d)
    reps = boot.replicates(rows, REPS, seed=SEED)
    return Statistics(boot.region_means(rows), boot.covariances(reps), tuple(t.POPULATIONS), tuple(map(float, t.BP_EDGES)))


@query(
    BOOT.replace("DENOM", "denom")
    + f""", m AS (SELECT row, stat_ord, sum(num) / nullif(sum(denom), 0) AS mean FROM regional GROUP BY row, stat_ord), v AS (SELECT row, stat_ord, var_samp(value) AS v FROM reps GROUP BY row, stat_ord),
    b AS (SELECT bin_id, (lo + hi) / 2.0 AS midpoint FROM bins)
    SELECT m.row, CAST(m.stat_ord AS BIGINT) AS stat_ord, midpoint, round(mean, 9) AS mean, round(sqrt(v) * {g.normal_quantile(0.95)!r}, 6) AS half_width
    FROM m LEFT JOIN v ON v.row = m.row AND v.stat_ord = m.stat_ord LEFT JOIN b ON b.bin_id = m.row"""
)
def h2_curves(spark: SparkSession, d: str) -> DataFrame:
    return table_statistics(spark, d).curves().withColumns({"mean": F.round("mean", 9), "half_width": F.round("half_width", 6)})


@query(
    BASE
    + """, k(stat_ord, new) AS (VALUES (7, 0), (2, 1), (0, 2)) SELECT row, CAST(new AS BIGINT) AS stat_ord, round(sum(num) / nullif(sum(denom), 0), 9) AS mean
    FROM regional JOIN k ON k.stat_ord = regional.stat_ord WHERE row IN (-1, 0, 1, 2, 3) GROUP BY row, new"""
)
def population_subset(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of two populations in another order, in bins up to 316 bp."""
    means = table_statistics(spark, d).subset(["P2", "P0"], high=316).means
    return long(means, "stat_ord").withColumn("mean", F.round("mean", 9))


@query(BASE + """, m AS (SELECT row, stat_ord, sum(num) / nullif(sum(denom), 0) AS mean FROM regional GROUP BY row, stat_ord)
    SELECT a.row, CAST(a.stat_ord AS BIGINT) AS stat_ord, round(a.mean, 9) AS mean, round(h.mean * h.mean, 9) AS h_squared, round(a.mean / nullif(h.mean * h.mean, 0), 9) AS ratio
    FROM m AS a JOIN m AS h ON h.stat_ord = a.stat_ord AND h.row = -1 WHERE a.row >= 0""")
def h2_and_h_squared(spark: SparkSession, d: str) -> DataFrame:
    rows = views.h2_and_h_squared(boot.region_means(region_table(spark, d)))
    return rows.withColumns({c: F.round(c, 9) for c in ("mean", "h_squared", "ratio")})


@query(BASE + " SELECT row, round(sum(denom), 6) AS pairs FROM regional WHERE row >= 0 AND stat_ord = 0 GROUP BY row")
def pair_count_table(spark: SparkSession, d: str) -> DataFrame:
    return views.pair_counts(region_table(spark, d)).withColumn("pairs", F.round("pairs", 6))


@query(BASE + """ SELECT region, row, CAST(stat_ord AS BIGINT) AS stat_ord, round(num, 6) AS num, round(denom, 6) AS denom FROM regional""")
def combined_regions(spark: SparkSession, d: str) -> DataFrame:
    """The regions of four files side by side, one a chromosome."""
    rows = region_table(spark, d)
    files = [rows.where(F.split("region", "_")[0] == str(c)) for c in range(4)]
    return boot.combine(*files).select("region", "row", "stat_ord", *[F.round(c, 6).alias(c) for c in ("num", "denom")])


@query(BASE + """ SELECT region, row, CAST(stat_ord AS BIGINT) AS stat_ord, round(num, 6) AS num, round(denom / 2 + row, 6) AS denom FROM regional""")
def replaced_denominators(spark: SparkSession, d: str) -> DataFrame:
    rows = region_table(spark, d)
    denoms = rows.where("stat_ord = 0").select("region", "row", (F.col("denom") / 2 + F.col("row")).alias("denom"))
    return boot.replace_denominators(rows, denoms).select("region", "row", "stat_ord", *[F.round(c, 6).alias(c) for c in ("num", "denom")])


# Files: written in text form to the shared folder and read again


def filed(spark: SparkSession, rows: DataFrame, write, *head: str) -> str:
    path = scratch(spark, "text")
    write(rows, path)
    if head:
        spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.mode("append").text(path)
    return path


VARIANTS = f"""v AS (SELECT sites.chrom, pos, o_orderstatus, o_orderkey, a0, b0, a1, b1 FROM orders JOIN sites ON o_orderkey * 10 + o_custkey % 10 = pos AND o_custkey % 4 = sites.chrom)"""


def variant_file(spark: SparkSession, d: str) -> str:
    columns = "#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT A B".split()
    return filed(spark, t.variant_lines(spark, d), lambda df, path: df.write.text(path), "##fileformat=VCFv4.2", "\t".join(columns))


@query(
    f"""WITH {SITES}, {VARIANTS} SELECT 'chr' || chrom AS chrom, pos, a0, b0, a1, b1, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 60 AS DOUBLE) END AS gq
    FROM v WHERE o_orderstatus <> 'P'"""
)
def vcf_genotypes(spark: SparkSession, d: str) -> DataFrame:
    """Genotypes and qualities of two samples from a variant file, sites of two alternatives left out."""
    rows = vcf.read_genotypes(spark, variant_file(spark, d), samples=["A", "B"])
    alleles = [F.col("gt")[s][a].cast("long").alias(f"{'ab'[a == 'a1']}{s}") for s in range(2) for a in ("a0", "a1")]
    return rows.select("chrom", "pos", *alleles, F.col("gq")[0].alias("gq"))


@query(
    f"""WITH {SITES}, {VARIANTS} SELECT 'chr' || chrom AS chrom, pos AS start, pos + 1 AS "end" FROM v"""
)
def vcf_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the positions of a variant file; no two sites are next to each other."""
    return vcf.coverage(spark, variant_file(spark, d))


@query(
    f"""WITH {SITES}, {ENDS} SELECT CAST(sites.chrom AS VARCHAR) AS chrom, pos, a0, b0, a3, b3 FROM sites JOIN ends ON ends.chrom = sites.chrom
    WHERE sites.chrom = 2 AND pos >= (SELECT min(stop) // 4 FROM ends) AND pos < (SELECT min(stop) // 2 FROM ends)"""
)
def block_gzip_region(spark: SparkSession, d: str) -> DataFrame:
    """All sites as one ordered block-gzipped file; a region of it is read by its index."""
    path = f"{scratch(spark, 'blocks')}.vcf.gz"
    sites = t.sites(spark, d).select(F.col("chrom").cast("string").alias("chrom"), "pos", F.lit("A").alias("ref"), F.array(F.lit("C")).alias("alt"), "gt")
    vcf.write_variants(sites, path, t.POPULATIONS)
    least = t.last_position(spark, d).agg(F.min("end").alias("end")).first()["end"]  # one row
    rows = vcf.read_genotypes(spark, path, region=(least // 4, least // 2), chrom="2")
    alleles = [F.col("gt")[s][a].cast("long").alias(f"{'ab'[a == 'a1']}{s}") for s in (0, 3) for a in ("a0", "a1")]
    return rows.select("chrom", "pos", *alleles)


@query(f"WITH {SITES}, {ENDS}, {MASK} SELECT CAST(chrom AS VARCHAR) AS chrom, lo AS start, hi AS \"end\" FROM mask WHERE hi - lo > 500")
def bed_file(spark: SparkSession, d: str) -> DataFrame:
    path = filed(spark, t.mask(spark, d), lambda df, path: bed.write_bed(df, path, header=True, compression="gzip"))
    return bed.read_bed(spark, path, 500)


@query(f"WITH {SITES}, {ENDS}, {STEPS} SELECT CAST(chrom AS VARCHAR) AS chrom, lo AS start, hi AS \"end\", CAST(rate AS DOUBLE) AS u FROM steps")
def bedgraph_file(spark: SparkSession, d: str) -> DataFrame:
    return bed.read_bedgraph(spark, filed(spark, t.step_map(spark, d), bed.write_bedgraph))


@query(f"WITH {SITES}, {ENDS}, {STEPS} SELECT CAST(chrom AS VARCHAR) AS chrom, lo AS start, hi AS \"end\", CAST(rate AS DOUBLE) AS u FROM steps")
def bedgraph_one_file(spark: SparkSession, d: str) -> DataFrame:
    """The steps as one ordered, block-gzipped file, and back."""
    path = f"{scratch(spark, 'steps')}.bedgraph.gz"
    bed.write_ordered(t.step_map(spark, d).repartition(5), path, sep=",")
    return bed.read_bedgraph(spark, path)


@query(
    f"""WITH {SITES} SELECT s.chrom, s.pos, CAST(r.u AS DOUBLE) AS u FROM sites AS s JOIN (SELECT pos, u FROM sites WHERE chrom = 1) AS r ON r.pos = s.pos WHERE s.chrom = 1
    UNION ALL SELECT -1 AS chrom, count(*) AS pos, CAST(sum(u) AS DOUBLE) AS u FROM sites WHERE chrom = 1"""
)
def dense_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of a chromosome as a dense array: written, read in parts, and gathered at its sites; its number of rates and their sum."""
    path = f"{scratch(spark, 'rates')}.npy"
    own = t.sites(spark, d).where("chrom = 1").select("chrom", "pos", F.col("u").cast("double").alias("u"))
    dense.write_dense(own, path)
    rates = dense.read_dense(spark, path, 1 << 16)
    found = maps.gather(own.select("chrom", "pos"), rates.withColumn("chrom", F.lit(1).cast("long")))
    total = rates.agg(F.lit(-1).cast("long").alias("chrom"), F.count("*").alias("pos"), F.sum("u").alias("u"))
    return found.unionByName(total)


@query(
    f"""WITH {SITES}, {ENDS}, {series("tiles", t.REGION, "k*25000 AS start, stop", 0)}
    SELECT '7' AS chrom, start, least(start + 25000, stop) AS l_end, stop AS r_end FROM tiles WHERE start < stop"""
)
def windows_file(spark: SparkSession, d: str) -> DataFrame:
    """Windows as text, some numbers with exponents; the chromosome is the caller's."""
    rows = region_tiling(spark, d).select(F.format_string("%e", F.col("start").cast("double")).alias("start"), "l_end", "r_end")
    path = filed(spark, rows, lambda df, path: df.write.csv(path, sep=" "))
    return bed.read_windows(spark, path, "7")


@query(
    f"""WITH {SITES}, n AS (SELECT count(*) AS n FROM sites), tiles AS (SELECT unnest(generate_series(0, (n - 1) // 97)) AS k FROM n) SELECT k * 97 AS start, (k + 1) * 97 AS "end" FROM tiles"""
)
def plain_tiles(spark: SparkSession, d: str) -> DataFrame:
    return intervals.plain_tiles(t.sites(spark, d).count(), 97, spark)


# Variant tables


#: Three files: every so many orders, the alternatives, and the genotypes of their samples by the order's key.
FILES = ((2, ("C",), ("1/1", "0/1")), (3, ("G", "C"), ("1/2",)), (5, ("T", "G"), ("2/2", "0/1")))


def merged_alleles() -> str:
    """Each file's alleles as letters, which need no numbers, beside the first file's order of them."""
    parts = []
    for n, (every, alts, gts) in enumerate(FILES):
        letters = ["A", *alts]
        alleles = ", ".join(f"'{letters[int(g.split('/')[k])]}' AS s{n}{j}{k}" for j, g in enumerate(gts) for k in (0, 1))
        parts.append(f"f{n} AS (SELECT o_custkey % 4 AS chrom, o_orderkey * 10 AS pos, {alleles}, {list(alts)!r} AS alts FROM orders WHERE o_orderkey % {every} = 0)")
    every = [f"s{n}{j}{k}" for n, (_, _, gts) in enumerate(FILES) for j in range(len(gts)) for k in (0, 1)]
    sites = " UNION ".join(f"SELECT chrom, pos FROM f{n}" for n in range(len(FILES)))
    joins = " ".join(f"LEFT JOIN f{n} ON f{n}.chrom = s.chrom AND f{n}.pos = s.pos" for n in range(len(FILES)))
    first = "list_concat(list_concat(coalesce(f0.alts, []), coalesce(f1.alts, [])), coalesce(f2.alts, []))"
    # An alternative's place among the distinct ones, in order of first appearance.
    order = f"list_transform(list_filter(list_transform(range(1, len({first}) + 1), lambda i: CASE WHEN list_position({first}, {first}[i]) = i THEN {first}[i] END), lambda a: a IS NOT NULL), lambda a: a)"
    numbers = ", ".join(f"CAST(CASE WHEN coalesce({c}, 'A') = 'A' THEN 0 ELSE list_position(alt, {c}) END AS BIGINT) AS {c}" for c in every)
    return f"""WITH {", ".join(parts)}, s AS ({sites}), m AS (SELECT s.chrom, s.pos, {", ".join(every)}, {order} AS alt FROM s {joins})
        SELECT chrom, pos, array_to_string(alt, ',') AS alt, {numbers} FROM m"""


@query(merged_alleles())
def variant_merge_outer(spark: SparkSession, d: str) -> DataFrame:
    """Three files whose alternatives clash, merged in one pass."""
    rows = t.table(spark, d, "orders").select((F.col("o_custkey") % 4).alias("chrom"), (F.col("o_orderkey") * 10).alias("pos"), F.col("o_orderkey").alias("k"))

    def file(every: int, alts: tuple[str, ...], gts: tuple[str, ...]) -> DataFrame:
        called = F.array(*[vcf.genotype(F.lit(g)) for g in gts])
        return rows.where(F.col("k") % every == 0).select("chrom", "pos", F.lit("A").alias("ref"), F.array(*map(F.lit, alts)).alias("alt"), called.alias("gt"))

    merged = vcf.merge_variants(*[file(*f) for f in FILES])
    names = [f"s{n}{j}" for n, (_, _, gts) in enumerate(FILES) for j in range(len(gts))]
    alleles = [F.col("gt")[i][a].cast("long").alias(f"{s}{a[1]}") for i, s in enumerate(names) for a in ("a0", "a1")]
    return merged.select("chrom", "pos", F.array_join("alt", ",").alias("alt"), *alleles)


@query("SELECT p_partkey, p_brand || CASE WHEN p_partkey % 3 = 0 THEN ',x' ELSE '' END AS alt FROM part WHERE p_partkey % 3 <> 0")
def biallelic_filter(spark: SparkSession, d: str) -> DataFrame:
    alt = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit(",x"))).otherwise(F.col("p_brand"))
    rows = t.table(spark, d, "part").select("p_partkey", F.split(alt, ",").alias("alt"))
    return vcf.biallelic(rows).select("p_partkey", F.col("alt")[0].alias("alt"))


@query(
    """SELECT CAST(l_partkey AS BIGINT) AS pos, round(sum(l_discount) * 1.015e-7 / 2 * 1e9, 6) AS u FROM lineitem GROUP BY l_partkey"""
)
def mut_vcf_rates(spark: SparkSession, d: str) -> DataFrame:
    info = F.concat(F.lit("AC=1;MR="), F.col("l_discount").cast("string"), F.lit(";X=2"))
    rows = t.table(spark, d, "lineitem").select(F.lit("1").alias("chrom"), F.col("l_partkey").alias("pos"), info.alias("info"))
    return vcf.summed_rates(rows).select("pos", F.round(F.col("u") * 1e9, 6).alias("u"))


@query("SELECT o_orderkey, 'chr' || o_custkey % 4 AS chrom FROM orders WHERE o_orderstatus <> 'F'")
def autosomes(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("o_orderstatus") == "F", "chrX").otherwise(F.concat(F.lit("chr"), (F.col("o_custkey") % 4).cast("string")))
    return vcf.autosomal(t.table(spark, d, "orders").select("o_orderkey", name.alias("chrom")))


# Readers of files, and the command that puts them together


@query(
    f"""WITH {SITES}, k AS (SELECT pos, pos // 5000 AS k FROM sites WHERE chrom = 1) SELECT pos,
    round(k*0.5 + (k % 3)*0.125 + (((k+1)*0.5 + ((k+1) % 3)*0.125) - (k*0.5 + (k % 3)*0.125)) * (pos - k*5000) / 5000.0, 9) AS cm FROM k"""
)
def rec_map_file(spark: SparkSession, d: str) -> DataFrame:
    """A map as text with a header and other columns, interpolated at a chromosome's sites."""
    knots = t.rec_map(spark, d).where("chrom = 1").select(F.concat_ws(" ", F.lit("1"), F.col("bp").cast("string"), F.lit("0.5"), F.col("cm").cast("string")).alias("value"), "bp")

    def write(df: DataFrame, path: str) -> None:
        head = spark.createDataFrame([("Chromosome Position(bp) Rate(cM/Mb) Map(cM)", -1)], "value string, bp long")
        df.unionByName(head).coalesce(1).sortWithinPartitions("bp").select("value").write.text(path)  # a line a knot of one chromosome

    knots = maps.checked_map(bed.read_recombination_map(spark, filed(spark, knots, write), "1"))
    sites = t.sites(spark, d).where("chrom = 1").select(F.lit("1").alias("chrom"), "pos")
    return maps.interpolate(sites, knots).select("pos", F.round("cm", 9).alias("cm"))


@query(
    """SELECT 'chr' || l_linenumber AS chrom, CAST(l_partkey AS BIGINT) AS pos, round(sum(l_discount) * 1.015e-7 / 2 * 1e9, 6) AS u FROM lineitem
    WHERE l_linenumber <> 7 GROUP BY l_linenumber, l_partkey"""
)
def mut_vcf_file(spark: SparkSession, d: str) -> DataFrame:
    """Rates of a mutation file: alternatives of a position summed, other than autosomes left out."""
    number = F.col("l_linenumber").cast("string")
    chrom = F.when(F.col("l_linenumber") == 7, "chrX").otherwise(F.concat(F.lit("chr"), number))
    info = F.concat(F.lit("AC=1;MR="), F.col("l_discount").cast("string"), F.lit(";X=2"))
    fields = [chrom, (F.col("l_partkey") + 1).cast("string"), F.lit("."), F.lit("A"), F.lit("C"), F.lit("."), F.lit("PASS"), info]
    lines = t.table(spark, d, "lineitem").select(F.concat_ws("\t", *fields).alias("value"))
    rates = vcf.read_mutation_rates(spark, filed(spark, lines, lambda df, path: df.write.text(path), "##contig=<ID=chr1,length=9>"))
    return rates.select("chrom", "pos", F.round(F.col("u") * 1e9, 6).alias("u"))


@query(
    f"""WITH {SITES}, n AS (SELECT max(pos) AS n FROM sites), ids AS (SELECT unnest(generate_series(0, 4 * n // 500 + 63)) AS id, n FROM n),
    sizes AS (SELECT id, n, CAST(ceil(-500.0::DOUBLE * ln(1 - CAST('0x' || substr(md5('7:' || id), 1, 15) AS BIGINT) / 1152921504606846976.0::DOUBLE)) AS BIGINT) AS size FROM ids),
    line AS (SELECT n, size, CAST(sum(size) OVER (ORDER BY id) AS BIGINT) AS stop FROM sizes)
    SELECT stop - size AS start, least(stop, n) AS "end" FROM line WHERE stop - size < n AND size > 0"""
)
def random_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Regions with exponential lengths, over the whole of the positions."""
    length = t.sites(spark, d).agg(F.max("pos").alias("n")).first()["n"]  # one row
    return intervals.random_tiles(length, 500.0, spark, 7)


#: A recombination fraction a base pair.
RATE = 1e-6


@query(
    f"""WITH {SITES}, {bins(t.CM_EDGES)}, m AS (SELECT chrom, pos, pos * {g.haldane_edges([RATE])[0]!r}::DOUBLE AS cm FROM sites),
    found AS (SELECT l.chrom AS chrom, bin_id, count(*) AS total FROM m AS l JOIN m AS r ON l.chrom = r.chrom AND r.pos > l.pos AND r.pos < l.pos + 3300 AND r.cm < l.cm + 0.32::DOUBLE
              JOIN bins ON r.cm >= l.cm + bins.lo::DOUBLE AND r.cm < l.cm + bins.hi::DOUBLE GROUP BY l.chrom, bin_id)
    SELECT g.chrom, CAST(b.bin_id AS BIGINT) AS bin_id, CAST(coalesce(f.total, 0) AS BIGINT) AS total
    FROM (SELECT DISTINCT chrom FROM sites) AS g CROSS JOIN bins AS b LEFT JOIN found AS f ON f.chrom = g.chrom AND f.bin_id = b.bin_id"""
)
def pair_counts_constant_rate(spark: SparkSession, d: str) -> DataFrame:
    """Bins in cM under one recombination fraction a base pair."""
    mapped = t.sites(spark, d).select("chrom", "pos", g.constant_map(F.col("pos"), RATE).alias("cm"))
    return long(pairs.pair_sums(mapped, t.CM_EDGES, ["chrom"], "cm"), "bin_id")


def command_sql() -> str:
    """Sums over sites in the mask and products of rates over its positions, by window, of one chromosome."""
    of_rates = ranked_sql(t.BP_EDGES, "pos", "rate", ON_STEPS)
    cut = of_rates.index("SELECT region, CAST(a.edge AS BIGINT)")
    return f"""{of_rates[:cut].rstrip()}, denoms AS ({of_rates[cut:]}), {LONG}, {EVERY_STATISTIC}, {BP},
    held AS (SELECT d.* FROM d JOIN m ON m.chrom = d.chrom AND d.pos >= lo AND d.pos < hi WHERE d.chrom = 1),
    h AS (SELECT region, stat_ord, CAST(-1 AS BIGINT) AS bin_id, sum(d4) / 4.0 AS num FROM held AS l JOIN windows AS w ON w.chrom = l.chrom AND l.pos >= start AND l.pos < least(l_end, r_end) GROUP BY region, stat_ord),
    h2 AS (SELECT region, l.stat_ord AS stat_ord, bin_id, sum(l.d4 * r.d4) / 16.0 AS num FROM held AS l JOIN held AS r ON l.stat_ord = r.stat_ord AND l.d4 > 0 AND r.d4 > 0 AND r.pos > l.pos AND r.pos < l.pos + 3162
           JOIN bins ON r.pos >= l.pos + bins.lo AND r.pos < l.pos + bins.hi JOIN windows AS w ON w.chrom = 1 AND l.pos >= start AND l.pos < l_end AND r.pos < r_end GROUP BY region, l.stat_ord, bin_id),
    nums AS (SELECT * FROM h UNION ALL SELECT * FROM h2)
    SELECT w.region, CAST(b.bin_id AS BIGINT) AS "row", CAST(s.stat_ord AS BIGINT) AS stat_ord, CAST(coalesce(num, 0) AS DOUBLE) AS num, CAST(coalesce(denom, 0) AS DOUBLE) AS denom
    FROM (SELECT * FROM windows WHERE chrom = 1) AS w CROSS JOIN stats AS s CROSS JOIN (SELECT CAST(-1 AS BIGINT) AS bin_id UNION ALL SELECT bin_id FROM bins) AS b
    LEFT JOIN nums ON nums.region = w.region AND nums.stat_ord = s.stat_ord AND nums.bin_id = b.bin_id LEFT JOIN denoms ON denoms.region = w.region AND denoms.bin_id = b.bin_id"""


@query(command_sql())
def parse_h2_files(spark: SparkSession, d: str) -> DataFrame:
    """The command on a chromosome's files: variants, mask, rates by step, bins, and windows that overlap."""
    from ..cli import parse_h2, parser

    base = scratch(spark, "command")
    sites = t.sites(spark, d).select(F.col("chrom").cast("string").alias("chrom"), "pos", F.lit("A").alias("ref"), F.array(F.lit("C")).alias("alt"), "gt")
    vcf.write_variants(sites, f"{base}.vcf.gz", t.POPULATIONS)
    bed.write_ordered(t.mask(spark, d), f"{base}.bed.gz")
    bed.write_ordered(t.step_map(spark, d), f"{base}.rates.gz", sep=",")
    # Windows of one chromosome, and a line of bins.
    lines = t.overlapping(spark, d).where("chrom = 1").orderBy(F.split("region", "_")[1].cast("long"))
    lines.select("start", "l_end", "r_end").coalesce(1).write.csv(f"{base}.windows", sep=" ")
    spark.createDataFrame([(" ".join(map(str, t.BP_EDGES)),)], "value string").coalesce(1).write.text(f"{base}.bins")
    files = {"vcf": f"{base}.vcf.gz", "bed": f"{base}.bed.gz", "mut_map": f"{base}.rates.gz", "regions": f"{base}.windows", "bins": f"{base}.bins", "out": f"{base}.out"}
    asked = parser().parse_args(["parse_h2", "--chrom", "1", *[x for k, v in files.items() for x in (f"--{k}", v)]])
    return long(parse_h2(spark, asked), "row", "stat_ord").select("region", "row", "stat_ord", "num", "denom")
