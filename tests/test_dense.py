"""Dense arrays: split reads, one file written, positions without a number."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlocus.operators import maps
from pairlocus.sources import bed, dense


@pytest.mark.parametrize("kind", ["<f8", "<f4", ">f8", "<i4"])
def test_arrays_of_numpy(spark, tmp_path, kind):
    values = np.arange(1000).astype(kind)
    want = {n: float(n) for n in range(1000)}
    if kind[1] == "f":
        values[::7] = np.nan
        want = {n: v for n, v in want.items() if n % 7}
    np.save(tmp_path / "a.npy", values)
    df = dense.read_dense(spark, str(tmp_path / "a.npy"), 300)
    assert df.rdd.getNumPartitions() == 4
    assert {r.pos: r.u for r in df.collect()} == want
    assert bed.read_mutation_map(spark, str(tmp_path / "a.npy"), "3").count() == len(want)


def test_one_file_and_back(spark, tmp_path):
    rng = np.random.default_rng(1)
    pos = rng.choice(200_000, 3000, replace=False)
    path = str(tmp_path / "w.npy")
    dense.write_dense(spark.createDataFrame([(int(p), float(p) / 3) for p in pos], "pos long, u double").repartition(5), path, 250_000)
    got = np.load(path)
    assert len(got) == 250_000 and np.flatnonzero(~np.isnan(got)).tolist() == sorted(pos.tolist())
    assert np.allclose(got[pos], pos / 3)
    assert {r.pos for r in dense.read_dense(spark, path).collect()} == set(pos.tolist())
    assert os.listdir(tmp_path) == ["w.npy"]
    with pytest.raises(Exception, match="there already"):
        dense.write_dense(dense.read_dense(spark, path), path)
    twice = spark.createDataFrame([(5, 1.0), (5, 2.0), (9, 1.0)], "pos long, u double")
    with pytest.raises(Exception, match="twice"):
        dense.write_dense(twice.coalesce(1), path + "2")
    assert os.listdir(tmp_path) == ["w.npy"]
    empty = dense.read_dense(spark, path).where("pos < 0")
    dense.write_dense(empty, str(tmp_path / "e.npy"), 3)
    assert np.isnan(np.load(tmp_path / "e.npy")).tolist() == [True] * 3


def test_a_missing_rate_fails(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.array([1.0, np.nan, 3.0]))
    rates = dense.read_dense(spark, str(tmp_path / "a.npy")).withColumn("chrom", F.lit("1"))
    asked = lambda *p: spark.createDataFrame([("1", x) for x in p], "chrom string, pos long")
    assert sorted(r.u for r in maps.gather(asked(0, 2), rates).collect()) == [1.0, 3.0]
    for p in (1, 7):
        with pytest.raises(Exception, match="no rate"):
            maps.gather(asked(0, p), rates).collect()


def test_other_files_are_refused(spark, tmp_path):
    np.save(tmp_path / "two.npy", np.zeros((2, 2)))
    (tmp_path / "text.npy").write_text("no array")
    for name, match in (("two", "one number"), ("text", "not a NumPy")):
        with pytest.raises(Exception, match=match):
            dense.read_dense(spark, str(tmp_path / f"{name}.npy")).collect()


def test_ordered_intervals(spark, tmp_path):
    rows = [(c, s, s + 5, s / 2) for c in ("1", "2") for s in range(0, 5000, 10)]
    path = str(tmp_path / "x.bedgraph.gz")
    bed.write_ordered(spark.createDataFrame(rows, "chrom string, start long, end long, u double").repartition(4), path, sep=",")
    assert [tuple(r) for r in bed.read_bedgraph(spark, path).collect()] == rows
    path = str(tmp_path / "x.bed.gz")
    bed.write_ordered(spark.createDataFrame(rows, "chrom string, start long, end long, u double").drop("u").repartition(4), path)
    assert [tuple(r) for r in bed.read_bed(spark, path).collect()] == [r[:3] for r in rows]
