"""SparkSession construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keep the broadcast decision size-checked by the planner (10 MB default).
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
}


def get_spark(master: str | None = None, app_name: str = "adlens",
              shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local session (tests) that leaves it unset gets a fresh scratch folder;
    on a cluster a missing setting is an error, since a node's own folder is not shared.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="adlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


@contextmanager
def few_listing_tasks(spark: SparkSession):
    """Many given files or folders are listed by a few tasks a core (Spark's default is a task for each, up to 10,000)."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint folder.

    A written table survives executor loss (unlike cached blocks) and lets
    several downstream outputs read one standardised fact without recomputing it.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/adlens-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    _WRITTEN[id(out)] = path
    if _OPEN:
        _OPEN[-1].append(path)
    return out


_WRITTEN: dict[int, str] = {}
_OPEN: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession):
    """Every table that :func:`materialize` writes inside the block is deleted at its end."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _drop(spark, path)


def _drop(spark: SparkSession, path: str) -> bool:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True))


def release(df: DataFrame) -> bool:
    """Delete the table behind a DataFrame returned by :func:`materialize` (after its last use).

    Only paths this module wrote under ``<checkpoint dir>/adlens-tables/`` are removed.
    """
    path = _WRITTEN.get(id(df))
    if not path or "/adlens-tables/" not in path:
        return False
    # ids can be reused after garbage collection: delete only if df really reads that table
    tail = path.split("://")[-1].replace("file:", "")
    if not all(f.split("://")[-1].replace("file:", "").startswith(tail) for f in df.inputFiles()):
        return False
    _WRITTEN.pop(id(df), None)
    return _drop(df.sparkSession, path)
