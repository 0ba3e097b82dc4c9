"""Session defaults and the shared folder for durable intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every job relies on; they can be set on a foreign session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a task that writes texts holds a whole row group of them
    "parquet.block.size": str(32 << 20),
    # windows of many keys outgrow the heap; this store keeps them on local disk
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

#: Settings that only a new session can take.
STATIC_CONF = {
    "spark.ui.enabled": "false",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def build_session(
    app_name: str = "rowforge", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**STATIC_CONF, **RUNTIME_CONF}
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Put the runtime settings on a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local session may go without the setting; it gets a fresh temporary
    folder, because driver and executors share one machine there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that all executors can reach"
        )
    folder = tempfile.mkdtemp(prefix="rowforge-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Scratch paths handed out and not yet removed, per application.
_SCRATCH: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder, removed when the application ends or by
    ``clean_up``."""
    application = spark.sparkContext.applicationId
    if application not in _SCRATCH:
        _SCRATCH[application] = []
        # registered after the session's own hooks, so it runs while the session is there
        atexit.register(_clean_up_at_exit, spark, application)
    path = f"{shared_dir(spark)}/rowforge/{name}-{uuid.uuid4().hex}"
    _SCRATCH[application].append(path)
    return path


def clean_up(spark: SparkSession, since: int = 0) -> int:
    """Removes the scratch paths of this application, from the ``since``-th on, and nothing
    else; returns their number. Frames that read them must not be used any more."""
    from .sources.files import remove_paths

    held = _SCRATCH.get(spark.sparkContext.applicationId, [])
    gone = held[since:]
    remove_paths(spark, gone)
    del held[since:]
    return len(gone)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes what the block has written to scratch paths when it ends. Results have to be
    written or collected inside the block."""
    before = len(_SCRATCH.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        clean_up(spark, before)


def _clean_up_at_exit(spark: SparkSession, application: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and context.applicationId == application:
        clean_up(spark)


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder, so that lost executors only
    cost a second read. Written as columns, so later steps read just what they need."""
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable_narrow(df: DataFrame) -> DataFrame:
    """``durable`` for rows of a few numbers, as edges and pairs: up to eight partitions go
    into one file, as long as every core has four. Such steps come by the dozen, and a file
    for each of their partitions costs more than its rows; on a local file system each one
    starts several processes."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return durable(df.coalesce(max(4 * spark.sparkContext.defaultParallelism, partitions // 8)))
