"""Session defaults and the shared folder that cuts lineage on a cluster."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Only a session that runs in one process gets
    a temporary one where it is unset; on a cluster that raises an error, because other machines can't read it."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = "file://" + os.path.join(tempfile.gettempdir(), "graphloom-shared")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(configured)
    return configured


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder; later readers survive the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpointed_by(df: DataFrame, *keys: str) -> DataFrame:
    """``checkpointed``, its rows partitioned by ``keys`` in as many partitions as the session shuffles into.

    What is grouped, ranked or, in another such call, joined by these keys and more is not shuffled again. An adaptive plan would
    forget its partitioning, so this one isn't adaptive; and a join is content with rows that lie together by a part of its keys.
    """
    spark = df.sparkSession
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        return checkpointed(df.repartition(slots(spark), *keys))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one for written tables; it is deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def slots(spark: SparkSession) -> int:
    """Shuffle partitions of the session, the unit of all salts and block counts."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, over at least as many partitions as the cluster has cores, for work whose cost is not its bytes.

    A scan that has them is left as it is, without a shuffle; this only helps tables of a few small files.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context: they need not have it on their own path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).parent
    target = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(target)
