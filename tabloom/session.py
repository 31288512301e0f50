"""Session defaults and the durable cut point used between heavy stages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(app: str = "tabloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.caseSensitive", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_LOCAL_DIRS: dict[str, str] = {}
_COLLECTORS: list[list[str]] = []


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The intermediate tables written meanwhile, by path, for ``remove`` once nothing reads them."""
    paths: list[str] = []
    _COLLECTORS.append(paths)
    try:
        yield paths
    finally:
        _COLLECTORS.remove(paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables, and the session's folder with the last of them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [*paths, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(conf)
        if path in paths or (system.exists(at) and not system.listStatus(at)):
            system.delete(at, path in paths)
    paths.clear()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        atexit.register(shutil.rmtree, _LOCAL_DIRS[sc.applicationId], ignore_errors=True)
    return _LOCAL_DIRS[sc.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Lineage is cut (a lost executor costs no recomputation of the stages
    before), and later passes read only the columns they touch.
    """
    path = scratch_path(df.sparkSession, label)
    for paths in _COLLECTORS:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Iterative training cuts its lineage in the shared folder too."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/checkpoints")


# Most rows, and most bytes of their cells, that a lookup table may have to be broadcast.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 8 << 20


def broadcast_if_small(table: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after rows and bytes are counted; a larger table joins by shuffle."""
    size = F.length(F.to_json(F.struct(*[F.col(f"`{n.replace('`', '``')}`") for n in table.columns])).cast("binary"))
    rows, total = table.select(size.alias("size")).limit(limit + 1).agg(F.count("*"), F.sum("size")).first()
    return F.broadcast(table) if rows <= limit and (total or 0) <= most_bytes else table
