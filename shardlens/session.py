"""Spark session and shared work folder.

The library never creates its own session implicitly: every public function takes
one. ``get_spark`` is a convenience for scripts and tests.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "shardlens", shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings this library is tested with.

    The master is, in order: the argument, ``SHARDLENS_MASTER``, the one the launcher
    configured (``spark-submit``), and ``local[*]`` when nothing names one.
    """
    master = master or os.environ.get("SHARDLENS_MASTER") or (None if _configured_master() else "local[*]")
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    if (master or _configured_master() or "local").startswith("local"):
        # Only here: executors on other hosts must reach the driver under its own address.
        builder = builder.config("spark.driver.host", "127.0.0.1").config("spark.driver.bindAddress", "127.0.0.1")
    builder = (
        builder
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _configured_master() -> str | None:
    """The master the launcher set, if any."""
    from pyspark import SparkConf

    try:
        return SparkConf().get("spark.master")
    except Exception:  # no JVM can be started from here; the builder will say so
        return None


def work_dir(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables.

    On a cluster this is the folder named by ``spark.checkpoint.dir`` (it must be on
    shared storage); without one a cluster session is refused. Only a local session
    that names none (tests) gets a folder of our own, registered as the checkpoint
    folder so ``checkpoint()`` works too.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a remote (Connect) session has no SparkContext here
        sc = None
    current = (sc.getCheckpointDir() if sc is not None else None) or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder on shared storage (executors "
                               "must read what other executors wrote there).")
        current = tempfile.mkdtemp(prefix="shardlens-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)  # scratch tables go with the session
        if sc is not None:
            sc.setCheckpointDir(current)
            current = sc.getCheckpointDir() or current
        else:
            spark.conf.set("spark.checkpoint.dir", current)
    return current.rstrip("/")


def parallelism(spark: SparkSession, default: int = 8) -> int:
    """Default task parallelism of the session (falls back when it cannot be read)."""
    try:
        return max(1, int(spark.sparkContext.defaultParallelism))
    except Exception:
        return max(1, int(spark.conf.get("spark.default.parallelism", str(default))))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused path under the work folder."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once per Spark context).

    Functions given to ``mapInPandas`` or ``pandas_udf`` are loaded there by module name, so a package that only
    the driver has on its path would fail. Not needed where it is installed or passed by ``--py-files``.
    """
    sc = spark.sparkContext
    if any(os.path.basename(str(f)) == "shardlens.zip" for f in sc.listFiles):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="shardlens-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "shardlens"), "zip", root, "shardlens"))
