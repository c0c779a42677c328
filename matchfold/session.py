"""Session and scratch-space helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


#: Settings the engine is tuned for; each is applied only where the session names none.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def is_local(master: str) -> bool:
    """Driver and executors are one process (``local-cluster`` is not)."""
    return master == "local" or master.startswith("local[")


def build_session(master: str | None = None, app_name: str = "matchfold", shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the engine is tuned for, filling in only what is unset.

    On a cluster, pass ``master=None``: spark-submit provides master, memory, shuffle
    partitions and ``spark.checkpoint.dir``, and none of them is overridden.  For a
    local master started from plain Python (tests, bench) the page is off, the driver
    gets 8 GB and shuffles get one partition per CPU.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    if master and is_local(master) and "PYSPARK_GATEWAY_PORT" not in os.environ:
        b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    spark = b.getOrCreate()
    given = spark.sparkContext.getConf()
    wanted = dict(DEFAULTS)
    if is_local(spark.sparkContext.master):
        wanted["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
    for key, value in wanted.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session; a fresh local directory is made only if the master is local.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="matchfold-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique directory under the checkpoint root for one materialisation."""
    return f"{checkpoint_root(spark).rstrip('/')}/matchfold/{name}-{uuid.uuid4().hex[:12]}"
