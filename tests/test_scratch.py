from pathlib import Path
from types import SimpleNamespace

import pyarrow as pa
import pytest

from pairlocus import scratch


class Conf(dict):
    def set(self, key, value):
        self[key] = value


def session(master, **conf):
    return SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_machines_must_share_a_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(session(master))
    assert scratch.shared_folder(session(master, **{"spark.checkpoint.dir": "hdfs://store/x/"})) == "hdfs://store/x"


def test_one_machine_takes_a_temporary_folder():
    own = session("local[2]")
    assert scratch.shared_folder(own).startswith("file:///") and scratch.shared_folder(own) == own.conf["spark.checkpoint.dir"]


def folders(spark):
    top = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "pairlocus"
    return {p.name for p in top.iterdir()} if top.is_dir() else set()


def test_tables_are_removed_with_their_scope(spark):
    before = folders(spark)
    outside = scratch.written(spark.range(3).toDF("a"), "outside")
    with scratch.temporary(spark):
        inner = scratch.written(outside, "inner")
        with scratch.temporary(spark):
            scratch.written(inner, "innermost")
        assert len(folders(spark) - before) == 2 and inner.count() == 3
    assert len(folders(spark) - before) == 1 and outside.count() == 3
    scratch.removed(outside)
    assert folders(spark) == before


def test_batch_limits_hold_while_a_table_is_written(spark):
    def lengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"id": pa.array([len(batch)], pa.int64())})

    before = spark.conf.get(scratch.BATCH_ROWS, None)
    sizes = spark.range(1000).coalesce(1).mapInArrow(lengths, "id long")
    assert scratch.written(sizes, "limited", batch_rows=100).agg({"id": "max"}).first()[0] == 100
    assert spark.conf.get(scratch.BATCH_ROWS, None) == before
