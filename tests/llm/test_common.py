import os

import pytest

from quern.llm import common


class _Session:
    """What shared_dir() asks of a session."""

    def __init__(self, master, folder=None):
        self.sparkContext = self
        self.master, self.folder = master, folder

    def getConf(self):
        return self

    def get(self, key):
        return self.folder

    def getCheckpointDir(self):
        return None


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]", "k8s://x"):
        with pytest.raises(ValueError):
            common.shared_dir(_Session(master))
        assert common.shared_dir(_Session(master, "hdfs://shared")) == "hdfs://shared"
    for master in ("local", "local[*]", "local[4]"):
        assert common.shared_dir(_Session(master)).startswith("file:///")


def test_settled_tables_go(spark, make):
    docs = make([(1, "a", "en", "x")])
    settled = common.settle(docs)
    folder = f"{common.shared_dir(spark).removeprefix('file://')}/quern-{spark.sparkContext.applicationId}"
    assert settled.collect() == docs.collect() and os.listdir(folder)
    common.clear(spark)
    assert not os.path.exists(folder)
