"""Session construction and the shared scratch folder.

Nothing here schedules work by hand; join strategies are left to Spark's byte
threshold and AQE.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

def build_session(master: str | None = None, app_name: str = "shelfgap",
                  shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """Create (or reuse) a session tuned for the batch jobs in this package.

    AQE stays on: it coalesces small shuffle partitions, turns joins whose
    measured side is small into broadcast joins, and splits skewed join
    partitions at runtime.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory is not None:   # only takes effect when this call starts the JVM
        builder = builder.config("spark.driver.memory", driver_memory)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    Intermediate tables go there.  Where it is unset a folder is made for a
    session that runs in one process; on a cluster that is an error, as each
    executor's part files would stay on its own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shelfgap-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder for written intermediate tables."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
