import pytest

from conftest import rows
from pagelode import session
from pagelode.streaming import windows


class Elsewhere:
    """A session as of a cluster, as far as shared_dir looks."""

    def __init__(self, master, at=None):
        self.conf = self
        self.sparkContext = self
        self.master, self.at = master, at

    def get(self, key, default=None):
        return self.at or default

    def getConf(self):
        return self


def test_cluster_needs_a_shared_folder():
    for master in ("spark://m:7077", "yarn", "local-cluster[3,2,1000]", "k8s://x"):
        with pytest.raises(RuntimeError):
            session.shared_dir(Elsewhere(master))
        assert session.shared_dir(Elsewhere(master, "hdfs:///tmp/x/")) == "hdfs:///tmp/x"


def test_scratch_is_deleted(spark):
    df = session.scratch(spark.range(3).toDF("n"), "gone")
    assert df.count() == 3 and session.forget(spark) >= 1
    assert session.forget(spark) == 0
    with pytest.raises(Exception):
        df.select("n").collect()


def test_stream_keeps_last_state_and_first_seen(spark, tmp_path):
    ddl = "ts timestamp, k string, v double"
    for i, part in enumerate(["('2024-01-01 10:00:00', 'a', 1.0), ('2024-01-01 10:30:00', 'a', 2.0)", "('2024-01-01 10:45:00', 'a', 4.0), ('2024-01-01 11:10:00', 'b', 1.0)"]):
        spark.sql(f"select cast(col1 as timestamp) ts, col2 k, cast(col3 as double) v from values {part}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}.parquet"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = windows.drain(windows.window_counts(stream, "ts", "k", "v"), "t", "update")
    assert got.select("batch").distinct().count() == 2
    last = {}
    for r in got.orderBy("batch").collect():
        last[r.w.start.hour, r.k] = (r.n, float(r.total))
    assert last == {(10, "a"): (3, 7.0), (11, "b"): (1, 1.0)}
    assert rows(windows.drain(windows.first_seen(stream, "ts", "k"), "f").select("k")) == [("a",), ("b",)]
