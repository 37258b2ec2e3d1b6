"""Spark session defaults and the shared checkpoint folder.

Everything in the library is a lazy ``DataFrame -> DataFrame`` function;
this module only owns the knobs a job sets once per session.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every job wants: AQE re-plans shuffles at runtime (coalescing tiny
# partitions, splitting skewed join partitions), UTC removes session-TZ drift,
# Arrow makes the few pandas boundaries columnar.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "ragloom",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; locally the
    shuffle partition count should track the core count, not Spark's 200.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, else the context's own.

    Only a local session, whose tasks run on this machine, may do without either;
    it gets a temporary folder. Anywhere else a folder that all executors share
    has to be named.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named is None and current is not None:
        return os.path.dirname(current)  # the context adds a folder of its own
    if named is None:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ragloom-checkpoints-")
    if current is None or not current.removeprefix("file:").startswith(named.removeprefix("file://").rstrip("/")):
        sc.setCheckpointDir(named)
    return named


def ship(spark: SparkSession) -> None:
    """Make the package importable in the Python workers, once per context.

    Jobs started from elsewhere have it on the driver's path only; the context's
    own file server hands the zipped package to every executor.
    """
    sc = spark.sparkContext
    if getattr(sc, "_ragloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.join(tempfile.mkdtemp(prefix="ragloom-zip-"), "ragloom")
    sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(root), os.path.basename(root)))
    sc._ragloom_shipped = True


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint into the shared folder (survives executor loss).

    Used where a plan is re-read many times or its lineage would otherwise
    grow without bound (iterative / incremental jobs).
    """
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for staged tables."""
    return os.path.join(checkpoint_dir(spark), "staged", name)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a staged table of ``scratch_path`` that nothing will read again."""
    if "/staged/" not in path:
        raise ValueError(f"{path} is not a staged table")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def spread(df, target: int | None = None):
    """Round-robin spread of an under-split input before heavy per-row work.

    A small source (one file, one row group) is scanned by a single task;
    text splitting and scoring after it would then run on one core. When
    the input has fewer partitions than the cluster's parallelism it is
    spread over ``target`` (default: the parallelism); a large input is
    left untouched, so on big data this adds no shuffle.
    """
    target = target or df.sparkSession.sparkContext.defaultParallelism
    try:
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 -- streaming frames have no RDD
        return df
    return df.repartition(target) if n < target else df
