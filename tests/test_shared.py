"""The shared folder, and tables kept whole by group."""

import pyarrow as pa
import pytest

from tidemark.functions.shared import shared_folder, whole_groups
from tidemark.model import Unsupported


class Session:
    """What :func:`shared_folder` asks of a session."""

    def __init__(self, master, folder=None):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: folder or default)})


def test_a_cluster_must_name_its_shared_folder(spark):
    assert shared_folder(Session("yarn", "hdfs:///shared/")).startswith("hdfs:///shared/tidemark-")
    assert shared_folder(Session("local[4]")).startswith("file:///tmp/")
    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,1024]"):
        with pytest.raises(Unsupported):
            shared_folder(Session(master))
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize("least", [1, 7, 40, 1000])
def test_groups_are_not_torn(least):
    rows = [(a, b) for a in (-5, 2, 9) for b in range(a % 4 + 1) for _ in range(6)]
    batches = [pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in rows[k : k + 5]]) for k in range(0, len(rows), 5)]
    tables = list(whole_groups(iter(batches), ["a", "b"], least))
    assert [r for t in tables for r in zip(t["a"].to_pylist(), t["b"].to_pylist(), strict=True)] == rows
    ends = [(t["a"][-1].as_py(), t["b"][-1].as_py()) for t in tables]
    starts = [(t["a"][0].as_py(), t["b"][0].as_py()) for t in tables]
    assert all(x != y for x, y in zip(ends, starts[1:], strict=False)) and len(set(starts)) == len(starts)
    assert list(whole_groups(iter([]), ["a"])) == []
