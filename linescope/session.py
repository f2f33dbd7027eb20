"""Session settings the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings; safe on any session, local or cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Malformed UTF-16 decodes with replacement characters instead of failing.
    spark.conf.set("spark.sql.legacy.codingErrorAction", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    A session on one machine that names none (tests) gets a temporary folder;
    on any other master that is an error.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="linescope-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and benches."""
    return configure(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("linescope")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="linescope-"))
        # The test tables are single small files: deal their rows to all cores.
        .config("spark.linescope.inputPartitions", cores)
        # Stack traces per column call cost more than building the plan.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
