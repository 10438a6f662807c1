"""Where shared tables go."""

from types import SimpleNamespace

import pytest

from estatelens import session


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default):
        assert key in ("spark.checkpoint.dir", "spark.sql.warehouse.dir")
        return self.value if self.value and key == "spark.checkpoint.dir" else default


def fake(named, master):
    return SimpleNamespace(conf=Conf(named), sparkContext=SimpleNamespace(master=master, applicationId="app-x"))


def test_the_named_folder_is_used():
    assert session.shared_dir(fake("hdfs://shared/work/", "spark://host:7077")) == "hdfs://shared/work"
    assert session.scratch_path(fake("s3://b/w", "yarn"), "t").startswith("s3://b/w/t-")


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError):
        session.shared_dir(fake(None, "yarn"))


def test_a_local_master_gets_one_folder_of_its_own():
    local = fake(None, "local[4]")
    assert session.shared_dir(local) == session.shared_dir(local) == "spark-warehouse/working"


def test_settled_tables_keep_their_schema(spark):
    df = spark.createDataFrame([(1, {"a": "b"}, [1.0], None)], "i int, m map<string,string>, x array<double>, s string")
    back = session.settle(df)
    assert back.schema.simpleString() == df.schema.simpleString() and back.collect() == df.collect()
    assert session.settle(df.where("i > 5")).isEmpty()
