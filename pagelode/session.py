"""Session helpers: table access and scratch tables in the folder all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Nothing is sent where workers find it anyway: on PYTHONPATH, or in the working directory of a local master.
    """
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        on_path.add(os.path.realpath(os.getcwd()))
    if str(root.parent) in on_path:
        return
    at = Path(tempfile.mkdtemp(prefix="pagelode-")) / "pagelode.zip"  # read by the driver only, which serves it to the workers
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(at))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset on one machine (tests) one is made and set.  On a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir isn't set: on {master} it must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pagelode-")
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors, and
    keeps the columns separately readable.  ``forget`` deletes what was written."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/pagelode/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    _MADE.append(at)
    return spark.read.schema(df.schema).parquet(at)


def forget(spark: SparkSession) -> int:
    """Delete all scratch tables of this process, on whatever file system they are; results that read them must have been used.  How many were deleted."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None:
            forget(spark)
    except Exception:  # the session is gone: files of this machine can still be deleted
        pass
    for at in _MADE:
        shutil.rmtree(at.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def small(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, which is counted first; otherwise left to a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """Give a heavy per-row stage at least a task per core: files of a single row group would otherwise make one task.
    Inputs that already have enough splits aren't shuffled."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
