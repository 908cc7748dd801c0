"""Where tables are stored: the cluster's folder, or a temporary one only locally."""

from types import SimpleNamespace

import pytest

from gradeloom.session import checkpointed, scratch_path, shared_dir


def fake(setting, master, own=None):
    conf = SimpleNamespace(get=lambda key, default=None: setting)
    return SimpleNamespace(
        conf=conf,
        sparkContext=SimpleNamespace(
            master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: own
        ),
    )


def test_the_setting_wins():
    assert shared_dir(fake("s3a://bucket/ck", "yarn")) == "s3a://bucket/ck"
    assert scratch_path(fake("/shared/", "yarn"), "t").startswith("/shared/gradeloom/t-")


def test_a_cluster_needs_the_setting():
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(fake(None, master))


def test_the_context_can_name_the_folder():
    assert shared_dir(fake(None, "yarn", "hdfs:///ck")) == "hdfs:///ck"


def test_a_local_session_keeps_one_folder():
    assert shared_dir(fake(None, "local[2]")) == shared_dir(fake(None, "local[2]"))


def test_stored_rows_are_the_same(spark):
    df = spark.range(100).withColumnRenamed("id", "n")
    assert sorted(checkpointed(df).collect()) == sorted(df.collect())
