"""The shared folder: named by the session, our own in local mode alone."""

from types import SimpleNamespace

import pytest

from marketloom.functions.lineage import shared_folder


def session(master, place=None):
    sc = SimpleNamespace(master=master, getConf=lambda: {"spark.checkpoint.dir": place} if place else {}, getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None)
    return SimpleNamespace(sparkContext=sc)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,3000]"])
def test_a_cluster_must_name_its_folder(master):
    with pytest.raises(ValueError):
        shared_folder(session(master), "x")
    assert shared_folder(session(master, "hdfs://a/b"), "x").startswith("hdfs://a/b/x-")


def test_local_mode_has_its_own():
    assert shared_folder(session("local[8]"), "x").startswith("file://")
    assert shared_folder(session("local"), "x").startswith("file://")
