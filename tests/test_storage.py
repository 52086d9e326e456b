import os
from types import SimpleNamespace

import pytest

from tidemark import storage


def test_a_cluster_needs_a_shared_folder(tmp_path):
    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            storage.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master)))
    found = storage.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]", setCheckpointDir=lambda p: None)))
    assert os.path.isdir(found)


def test_tables_written_on_the_way_are_deleted(spark):
    with storage.intermediates(spark):
        with storage.intermediates(spark):
            inner = storage.materialise(spark.range(3), "inner")
            outlives = storage.kept(spark.range(4), "outlives")
        gone = inner.inputFiles()
        assert outlives.count() == 4 and not any(os.path.exists(f.removeprefix("file://")) for f in gone)
        files = outlives.inputFiles()
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
