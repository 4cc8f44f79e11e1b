"""Session set-up and shared working folders."""

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str, master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the operators are planned for.

    Shuffle partitions are left to the cluster (adaptive execution coalesces and
    splits them in batch jobs); streaming queries set theirs when they start.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **{key: str(value) for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the cluster.

    The folder comes from spark.checkpoint.dir. Only a local session without the
    setting (tests, a laptop) falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ledgerlens-")
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


def stream_session(spark: SparkSession) -> SparkSession:
    """Session of the same application for stateful streams.

    State is partitioned once and for all at the first start, and every partition
    costs a store per operator, so the count follows the cores instead of the
    batch default. RocksDB keeps large state off the heap; without its count of rows
    a write needs no read before it.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.shuffle.partitions", str(max(4, spark.sparkContext.defaultParallelism)))
    session.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    return session
