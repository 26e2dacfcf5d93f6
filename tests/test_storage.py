"""Tables in the shared folder."""

import os
from types import SimpleNamespace

import pytest

from cropmill import storage


def test_shared_folder_is_the_cluster_s():
    conf = SimpleNamespace(get=lambda name, default=None: "hdfs://x/y/")
    assert storage.shared_dir(SimpleNamespace(conf=conf)) == "hdfs://x/y"


def context(conf, master, folder=None):
    return SimpleNamespace(applicationId="app-1", master=master, getConf=lambda: conf, getCheckpointDir=lambda: folder)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_a_cluster_must_name_a_shared_folder(master):
    none = SimpleNamespace(get=lambda name, default=None: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(SimpleNamespace(conf=none, sparkContext=context(none, master)))
    assert storage.shared_dir(SimpleNamespace(conf=none, sparkContext=context(none, master, "hdfs://x/c"))) == "hdfs://x/c"


def test_own_folder_where_none_is_named():
    none = SimpleNamespace(get=lambda name, default=None: None)
    spark = SimpleNamespace(conf=none, sparkContext=context(none, "local[4]"))
    at = storage.shared_dir(spark)
    assert at == storage.shared_dir(spark) and os.path.isdir(at.removeprefix("file://"))


def test_settle_and_purge(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    back = storage.settle(df, "t")
    assert sorted(back.collect()) == sorted(df.collect()) and back.schema == df.schema
    at = back.__dict__["settled_at"].removeprefix("file://")
    assert os.path.isdir(at)
    storage.release(back, None, df)
    storage.release(back)
    assert not os.path.isdir(at)
    storage.purge(spark)
    assert not os.path.isdir(storage.own_folder(spark).removeprefix("file://"))


def test_batches_only_get_smaller(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "1000")
    storage.small_batches(spark)
    assert spark.conf.get(name) == "1000"
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)
