"""Every query that has SQL equals what DuckDB makes of the SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from pairlocus.plans import derived, queries

DATA = Path("/root/testdata/sf0.001")
#: The smallest tables have a dozen regions, whose covariances of ten statistics have no inverse.
LARGER = {"gaussian_bin_ll": DATA.with_name("sf0.01"), "gaussian_total_ll": DATA.with_name("sf0.01")}
NAMES = sorted(queries.ORACLE_SQL)

pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the tables aren't here")


@pytest.fixture(scope="module")
def duck():
    found = {}
    for folder in {DATA, *LARGER.values()}:
        found[folder] = duckdb.connect()
        for path in folder.glob("*.parquet"):
            found[folder].execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return found


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    folder = LARGER.get(name, DATA)
    got = queries.QUERIES[name](spark, str(folder))
    cursor = duck[folder].execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, cursor.fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_seconds_of_events_are_rounded(spark, tmp_path):
    """Fractions of a second round to whole ones, halves to even ones, as in the SQL; unknown users pair with nobody; empty bins are there."""
    seconds = [0.4, 10.4, 20.5, 21.5, 80.6, 80.4, 141.0, 745.5]
    rows = [(n, 1 + n % 2, f"2024-01-01 00:{int(s) // 60:02d}:{s % 60:09.6f}") for n, s in enumerate(seconds + [11.6, 12.5])]
    rows += [(50, None, "2024-01-01 00:00:00"), (51, None, "2024-01-01 00:00:05")]
    for name, kept in (("some", rows), ("none", rows[:0])):
        folder = tmp_path / name
        table = spark.createDataFrame(kept, "event_id long, user_id long, at string").selectExpr("event_id", "cast(at as timestamp_ntz) as ts", "user_id")
        table.coalesce(1).write.parquet(str(folder / "events.parquet"))
        duck = duckdb.connect()
        duck.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
        want = duck.execute(queries.ORACLE_SQL["pair_counts_events_by_user"]).fetchall()
        got = queries.QUERIES["pair_counts_events_by_user"](spark, str(folder)).collect()
        assert sorted((r.bin_id, r.total) for r in got) == sorted(want)


def test_series_are_made_by_many_tasks(spark):
    """Intervals of a chromosome don't come out of one task; there are as many as the tables' last positions ask for."""
    d = str(DATA)
    ends = {r.chrom: r.end for r in derived.last_position(spark, d).collect()}
    for table, step, extra in ((derived.mask, 700, 0), (derived.second_mask, 1100, 0), (derived.rec_map, 5000, 1), (derived.flat_map, 4096, 1), (derived.tiles, derived.REGION, 1)):
        rows = table(spark, d)
        assert {r.chrom: r["count"] for r in rows.groupBy("chrom").count().collect()} == {c: end // step + extra + 1 for c, end in ends.items()}
        assert rows.rdd.getNumPartitions() >= 2 * len(ends)


def test_steps_of_rates_are_made_by_many_tasks(spark):
    ends = {r.chrom: r.end for r in derived.last_position(spark, str(DATA)).collect()}
    steps = derived.step_map(spark, str(DATA))
    want = {(c, 1000 * k, 1000 * k + 1000, 1 + k % 9) for c, end in ends.items() for k in range(end // 1000 + 1) if k % 5 != 4}
    assert {tuple(r) for r in steps.collect()} == want
    assert steps.rdd.getNumPartitions() >= 2 * len(ends)
