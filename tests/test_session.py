"""The staging folder: local only where driver and executors are one process."""

import time

import pytest

from tastemill import session
from tastemill.session import FREE_SHUFFLES_CONF, freed_shuffles


class Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):  # noqa: N802 - Spark's name
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802 - Spark's name
        self.folder = folder


class Session:
    def __init__(self, master, folder=None):
        self.sparkContext = Context(master)
        self.conf = {"spark.checkpoint.dir": folder}


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        session.checkpoint_dir(Session(master))
    assert session.checkpoint_dir(Session(master, "hdfs://shared/x")) == "hdfs://shared/x"


def test_a_local_session_may_do_without(tmp_path, monkeypatch):
    monkeypatch.setattr(session.tempfile, "mkdtemp", lambda prefix: str(tmp_path / prefix))
    assert session.checkpoint_dir(Session("local[4]")).startswith(str(tmp_path))


def test_shuffle_files_go_with_what_ran(spark, tmp_path):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before, setting = files(), spark.conf.get(FREE_SHUFFLES_CONF, None)
    rows = spark.range(1000).groupBy("id").count()
    with freed_shuffles(spark):
        rows.write.parquet(str(tmp_path / "a"))
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(FREE_SHUFFLES_CONF, None) == setting
    assert spark.read.parquet(str(tmp_path / "a")).count() == rows.count() == 1000
