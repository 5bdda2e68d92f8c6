"""The shared scratch folder."""

import pytest

from leafmill import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Fake:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_cluster_folder_is_used():
    a = session.scratch_path(Fake(spark_checkpoint_dir="hdfs://shared/x/"), "t")
    assert a.startswith("hdfs://shared/x/t-")
    assert a != session.scratch_path(Fake(spark_checkpoint_dir="hdfs://shared/x/"), "t")


def test_local_folder_only_when_unset():
    a, b = session.scratch_path(Fake(), "t"), session.scratch_path(Fake(), "t")
    assert a.startswith("/tmp/spark-") and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0]


def test_cluster_without_folder_is_refused():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.scratch_path(Fake(spark_master=master), "t")


def test_materialize_reads_back(spark):
    df = session.materialize(spark.range(5).selectExpr("id", "array(struct(id as a)) as s"), "t")
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().executedPlan().toString().lower()
