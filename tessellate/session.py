"""Spark session and lineage helpers.

The library never creates its own scratch space on a cluster: iterative
operators cut lineage with ``DataFrame.checkpoint()`` into the shared folder
named by ``spark.checkpoint.dir``.  Only when that setting is absent (unit
tests, local runs) is a fresh folder under the local temp dir used.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "tessellate",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings this library is tuned for.

    AQE is on (coalescing small shuffle partitions, skew-join splitting);
    the UI is off; Arrow is used for the few pandas batch operators.  The
    master, the number of shuffle partitions and the driver's memory are set
    only if given: what spark-submit or the cluster says stands."""
    b = (SparkSession.builder
         .appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if os.environ.get("SPARK_DRIVER_MEMORY"):
        b = b.config("spark.driver.memory", os.environ["SPARK_DRIVER_MEMORY"])
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if is_local(spark):
        ensure_checkpoint_dir(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    """True when driver and executors are one process on this machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder.  A local one is set, and removed
    at exit, only where the setting is absent and all executors are this
    machine's; on a cluster without the setting this raises."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="tessellate-ckpt-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    import uuid
    return f"{base}/tables/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return _bounded_size(df.checkpoint(eager=eager))


def _bounded_size(df: DataFrame) -> DataFrame:
    """A checkpointed table without the size that the planner guessed for it, if
    that is beyond any table.  A checkpoint keeps the guess of the plan that made
    it, and a join's is the product of its sides': in a loop of joins its digits
    double each round, and planning a later round does not end."""
    plan = df._jdf.logicalPlan()
    if int(plan.stats().sizeInBytes()) < 1 << 63:
        return df
    none = df.sparkSession._jvm.scala.Option.empty()
    plain = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(),
                      df._jdf.sparkSession(), none, none)
    return type(df)(df.sparkSession._jvm.org.apache.spark.sql.classic.Dataset.ofRows(df._jdf.sparkSession(), plain), df.sparkSession)
