"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Temporary folders of sessions on this machine, by application.
_OWN: dict[str, str] = {}


def build_session(app: str = "voxlake", cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tested under.

    ``cpus`` asks for a session on this machine. Without it the master, the memory and the number of shuffle
    partitions stay what the cluster sets.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Facts of a key are joined to its rows; a hot key's rows are split even if that costs another shuffle.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    }
    builder = SparkSession.builder.appName(app)
    if cpus is not None:
        builder = builder.master(f"local[{cpus}]")
        settings["spark.ui.enabled"] = "false"
        settings["spark.driver.memory"] = os.environ.get("VOXLAKE_DRIVER_MEMORY", "8g")
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and stream output, named by ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a temporary folder; on a cluster, where executors and
    driver do not share local folders, it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not re.match(r"local(\[[^\[\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later steps do not recompute it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
