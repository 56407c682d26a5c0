"""Session and checkpoint settings shared by tests, bench and jobs."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, partitions: int = 8, name: str = "quire") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The session's shared folder for checkpoints.

    It is ``spark.checkpoint.dir``; only a local master, whose tasks all run on this machine, may do without and gets a
    temporary one. A cluster without the setting is an error, as its executors don't share their disks.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quire-"))
    return sc._jsc.sc().getCheckpointDir().get()


_TABLES: dict[str, SparkSession] = {}
#: Rows of a side that is sent to all executors, at most; of some hundred bytes each, that is a few megabytes.
BROADCAST_ROWS = 50_000


def checkpointed(df: DataFrame, frees: DataFrame | None = None) -> DataFrame:
    """Cut the lineage by a table written to the shared checkpoint folder, compressed and read back by column.

    It survives the loss of executors, unlike localCheckpoint, which is never used. ``frees``: an earlier table that
    nothing but ``df`` was made from; it is removed once ``df`` is written. Other tables go when the driver ends, or
    with ``release``.

    The planner knows a table by the size of its files, which for keys and flags is a small part of what it takes in memory.
    So it is counted, once (``_rows``), and of more than BROADCAST_ROWS rows it is never broadcast.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _TABLES:
        atexit.register(release)
    _TABLES[path] = spark
    old = getattr(frees, "_table", None)
    if old:
        _remove(old)
    out = spark.read.schema(df.schema).parquet(path)
    rows = out.count()
    out = shuffled(out, rows)
    out._table, out._rows = path, rows
    return out


def shuffled(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of so many rows, marked for sort-merge joins where it is too large to be sent to all executors.

    A union takes no mark from its parts and needs its own.
    """
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def release() -> None:
    """Remove all checkpointed tables; results that were made from them and not written yet can't be read any more."""
    for path in list(_TABLES):
        _remove(path)


def _remove(path: str) -> None:
    spark = _TABLES.pop(path, None)
    if spark is None:
        return
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone before
        pass


def met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a side of narrow rows that is written and counted first: broadcast up to ``most`` rows, else shuffled.

    Both ways give the same rows; an expression that goes before the join on ``left`` isn't shuffled where the side is small.
    """
    right = checkpointed(right)
    return left.join(F.broadcast(right) if right._rows <= most else right, on, how)
