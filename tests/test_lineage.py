"""The folder of cut lineages."""

from types import SimpleNamespace

import pytest

from panelspark.operators.lineage import shared_folder


def test_a_cluster_must_name_its_shared_folder():
    unset = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(master="spark://somewhere:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)


def test_one_process_makes_a_folder(spark):
    assert shared_folder(spark)
