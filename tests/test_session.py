from types import SimpleNamespace

import pytest

from claimspark import session
from claimspark.sources import tables


def fake(master, conf):
    context = SimpleNamespace(
        master=master, applicationId=f"app-{master}", getConf=lambda: SimpleNamespace(get=lambda k: None)
    )
    return SimpleNamespace(conf=SimpleNamespace(get=conf.get), sparkContext=context)


def test_shared_folder_comes_from_the_session():
    named = {"spark.checkpoint.dir": "/shared/checkpoints"}
    assert session.shared_dir(fake("yarn", named)) == "/shared/checkpoints"
    assert session.shared_dir(fake("local[2]", named)) == "/shared/checkpoints"


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("yarn", {}))


def test_a_local_session_keeps_one_folder():
    local = fake("local[2]", {})
    assert session.shared_dir(local) == session.shared_dir(local)


def test_written_table_equals_its_source(spark):
    df = spark.createDataFrame([(1, ["a"], None), (2, None, "x")], "id INT, l ARRAY<STRING>, s STRING")
    stored = session.written(df)
    assert stored.schema == df.schema
    assert sorted(stored.collect(), key=lambda r: r.id) == df.collect()


def test_only_small_inputs_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert tables.spread(one, "id").rdd.getNumPartitions() == cores
    many = spark.range(0, 100, 1, cores * 3)
    assert tables.spread(many, "id") is many


def test_shuffles_are_dropped_only_meanwhile(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    with pytest.raises(ValueError, match="meanwhile"), session.shuffles_dropped(spark):
        assert spark.conf.get(key) == "true"
        raise ValueError("meanwhile")
    assert spark.conf.get(key) == before
