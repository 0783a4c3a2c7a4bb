"""Spark session helpers.

The library never creates a cluster-wide setting it does not own: it reads
``spark.checkpoint.dir`` from the running session and only fills it in when
it is unset (local runs and tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quarry") -> SparkSession:
    """A local session for tests and benchmarks (one JVM, ``cores`` threads)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A local session (one machine, as in tests) gets a temporary folder when it is unset; on a cluster that is an
    error, since executors would not see the driver's folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:  # noqa: BLE001
            root = None
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not root:
        root = _LOCAL_ROOT.setdefault("dir", tempfile.mkdtemp(prefix="quarry-ckpt-"))
    return root


_LOCAL_ROOT: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point ``DataFrame.checkpoint()`` at the checkpoint root (once per application)."""
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return spark.sparkContext.getCheckpointDir()


def checkpoint_dir(spark: SparkSession) -> str:
    return checkpoint_root(spark)


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable in Python workers (executors), once per SparkContext.

    UDFs refer to classes and functions of this package; executors get it as a
    zip through ``addPyFile``, which Spark distributes to every node.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quarry_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="quarry-pyfiles-"), "quarry.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(out)
    sc._quarry_shipped = True
