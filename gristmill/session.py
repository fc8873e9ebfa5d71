"""Session construction with the settings every operator assumes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Up to this size the small side of a join is broadcast, so that the large side isn't shuffled.
BROADCAST_BYTES = 64 << 20

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "gristmill", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution on, stream state in RocksDB; extra settings by keyword (dots as ``__``)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the place that ``spark.checkpoint.dir`` names; only a local session may do without one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"


def few(keys: DataFrame, row_bytes: int = 64) -> bool:
    """Whether these keys, whose rows are counted here, may be broadcast."""
    return row_bytes * keys.count() <= BROADCAST_BYTES


def reliable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
