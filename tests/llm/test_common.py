import pytest
from whence.llm import common


class Fake:
    """A session whose settings can be chosen."""

    def __init__(self, master, base=None):
        self.conf = self
        self.sparkContext = self
        self.master, self.base, self.applicationId = master, base, f"app-{master}-{base}"

    def get(self, key, default=None):
        assert key == "spark.checkpoint.dir"
        return self.base or default


def test_shared_folder():
    assert common.shared_dir(Fake("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    local = Fake("local[2]")
    assert common.shared_dir(local).startswith("file:///") and common.shared_dir(local) == common.shared_dir(local)
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://h:7077"):
        with pytest.raises(RuntimeError):
            common.shared_dir(Fake(master))


def test_written_tables(spark):
    df = common.written(spark.createDataFrame([], "a long, b array<string>"), "none")
    assert df.collect() == [] and df.dtypes == [("a", "bigint"), ("b", "array<string>")]
