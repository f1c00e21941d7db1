"""The shared folder of the training-data operators: a cluster must name it."""

from types import SimpleNamespace

import pytest

from marketloom.llm.common import shared_dir


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[3,2,3000]"])
def test_no_machine_local_folder_on_a_cluster(master):
    sc = SimpleNamespace(master=master, getConf=lambda: {}, getCheckpointDir=lambda: None, setCheckpointDir=lambda x: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(sparkContext=sc))
    sc.master = "local[8]"
    assert shared_dir(SimpleNamespace(sparkContext=sc)).startswith("file://")
