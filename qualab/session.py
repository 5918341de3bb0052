"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

_scratch: dict[str, str] = {}    # by application, for local sessions without the setting


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "qualab") -> SparkSession:
    """Session with the settings the library assumes (AQE on, UTC, no UI).

    On a cluster call this without ``master``; the cluster's own settings win.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        # a local launch: the driver JVM is the only executor, so it needs the heap
        builder = builder.master(master).config("spark.driver.memory",
                                                os.environ.get("QUALAB_DRIVER_MEMORY", "16g"))
    builder = (builder
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, set as the context's checkpoint folder.

    Where the setting is missing, a local session (tests, one machine) gets a scratch folder, once;
    on a cluster that is an error, as executors do not share the driver's disk.
    """
    context = spark.sparkContext
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = _scratch.get(context.applicationId)
        if conf_dir is None:
            conf_dir = _scratch[context.applicationId] = tempfile.mkdtemp(prefix="qualab-ckpt-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(conf_dir)
    return conf_dir
