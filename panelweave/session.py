"""Session settings for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", app: str = "panelweave") -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    n = os.cpu_count() if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(max(2, n)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    A cluster names it in ``spark.checkpoint.dir``. Only a session without one (tests,
    a laptop) gets a temporary folder, since executors on other machines could not read it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name for written results, in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back from there.

    Several branches that must agree on the very same rows (down to the last bit of a
    floating sum) read this copy; a lost executor cannot change it.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def land(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """``df`` written once as Parquet to the shared checkpoint folder and read back: as ``freeze``, but compressed.

    With ``batch`` Python gets so many rows at a time at most.
    """
    path, conf, key = scratch(df.sparkSession, name), df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key, None)
    try:
        if batch:
            conf.set(key, str(batch))
        df.write.parquet(path)
    finally:
        if batch:
            conf.unset(key) if before is None else conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
