"""Where intermediate data goes."""

from types import SimpleNamespace

import pytest

from parapet.session import shared_folder


def session(master, root):
    settings = {"spark.checkpoint.dir": root} if root else {}
    conf = SimpleNamespace(get=settings.get, set=settings.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)), settings


@pytest.mark.parametrize("master", ["local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://https://h"])
def test_a_cluster_has_to_name_its_folder(master):
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared_folder(session(master, None)[0], "x")
    for root in ("hdfs://host/shared", "file:///tmp/shared"):
        spark, settings = session(master, root)
        assert shared_folder(spark, "x").startswith(f"{root}/parapet-x-")
        assert settings == {"spark.checkpoint.dir": root}


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_a_local_master_may_do_without(master):
    spark, settings = session(master, None)
    first = shared_folder(spark, "x")
    assert first.startswith(settings["spark.checkpoint.dir"])
    assert shared_folder(spark, "y").startswith(settings["spark.checkpoint.dir"])
