import pytest

from kappaflow import session


class FakeConf(dict):
    def get(self, key, default=None):
        return super().get(key, default)

    def set(self, key, value):
        self[key] = value


class FakeSpark:
    def __init__(self, **conf):
        self.conf = FakeConf({k.replace("_", "."): v for k, v in conf.items()})


def test_shared_dir_is_the_configured_folder():
    assert session.shared_dir(FakeSpark(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["yarn", "spark://h:1", "local-cluster[2,1,1024]", "k8s://h"])
def test_shared_dir_fails_without_setting_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(FakeSpark(spark_master=master))


def test_shared_dir_of_a_local_session():
    s = FakeSpark(spark_master="local[2]")
    assert session.shared_dir(s) == session.shared_dir(s) == s.conf["spark.checkpoint.dir"]


def test_submitted_settings_win(monkeypatch):
    set_ = {}

    class Builder:
        def appName(self, n):
            return self

        def master(self, m):
            set_["spark.master"] = m
            return self

        def config(self, k, v):
            set_[k] = v
            return self

        def getOrCreate(self):
            class S:
                class sparkContext:
                    setLogLevel = staticmethod(lambda level: None)
            return S

    monkeypatch.setattr(session.SparkSession, "builder", Builder())
    session.build_session()
    assert not {"spark.master", "spark.driver.memory", "spark.sql.shuffle.partitions", "spark.checkpoint.dir"} & set(set_)
