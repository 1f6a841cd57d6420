"""SparkSession construction and shared scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Defaults for local runs. They are set only where nobody has set the key.
_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}
# Partitions that small text tables are spread over (see sources.tables.read_table).
SPREAD_KEY = "spark.almanac.spread"


def is_local(master: str | None) -> bool:
    """Whether a master runs everything in this process (``local``, ``local[n]``)."""
    return master is not None and (master == "local" or master.startswith("local["))


def build_session(master: str | None = None, app_name: str = "almanac",
                  conf: dict[str, str] | None = None) -> SparkSession:
    """Create a session, or return the running one with only ``conf`` applied.

    The local defaults are used for a new session on a local master, and only
    for keys that neither ``conf`` nor the submitter's configuration has."""
    conf = dict(conf or {})
    running = SparkSession.getActiveSession()
    if running is None:
        given = SparkConf()
        if is_local(master or given.get("spark.master", None)):
            conf = {**{k: v for k, v in _LOCAL_CONF.items() if not given.contains(k)}, **conf}
        builder = SparkSession.builder.appName(app_name)
        if master:
            builder = builder.master(master)
        running = builder.config(map=conf).getOrCreate() if conf else builder.getOrCreate()
    else:
        for key, value in conf.items():
            if running.conf.isModifiable(key):
                running.conf.set(key, value)
    running.sparkContext.setLogLevel("ERROR")
    return running


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster it must be set, to a file system that all executors share; only
    where everything runs in one process (local runs and tests) is a folder of
    our own made when it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="almanac-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/almanac/{name}-{uuid.uuid4().hex[:12]}"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
