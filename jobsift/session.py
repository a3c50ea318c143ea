"""Session settings and the shared work folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs are designed for.  None of them is needed for correctness.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Merge the rows of a session before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`SETTINGS`; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName("jobsift")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder every executor can reach.

    The cluster names the shared root in ``spark.checkpoint.dir``.  Only a
    local master may fall back to a folder on this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="jobsift-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_recorders: list[list[str]] = []


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that ``materialize`` writes inside the block, in a list that grows."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders[:] = [r for r in _recorders if r is not paths]


def remove_tables(spark: SparkSession, paths: Iterable[str], still_read: DataFrame | None = None) -> list[str]:
    """Delete folders that ``materialize`` wrote; returns those that ``still_read`` reads, which stay."""
    files = still_read.inputFiles() if still_read is not None else []
    kept = []
    for path in paths:
        # The last part of a path, a name with a UUID, occurs nowhere else.
        if any(path.rpartition("/")[2] in f for f in files):
            kept.append(path)
        else:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return kept


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For results that are costly or not repeatable (a scorer's answers) and are
    used more than once: lost executors then cost a re-read, not a re-run.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    for paths in _recorders:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
