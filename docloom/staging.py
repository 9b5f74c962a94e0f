"""Tables staged in the folder that the cluster shares: lineage is cut there, never on a machine's own disk."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_staged: dict[str, SparkSession] = {}
_local_dir: list[str] = []
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset and the master is ``local``, a temporary folder serves;
    on any other master that would lose data, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="docloom-"))
    return "file://" + _local_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    _staged[path] = spark
    for scope in getattr(_scopes, "open", ()):
        scope.append(path)
    return path


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet, with ``options``, into the shared folder and read it back.

    This cuts lineage: work above it is not repeated when an executor is lost,
    nor when several later plans read the table. The planner knows its size.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_path = path  # for drop(); frames derived from it don't have it
    return table


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read any more; frames that aren't staged tables are passed over."""
    for table in tables:
        path = getattr(table, "_staged_path", None)
        if path in _staged:
            _remove(_staged.pop(path), path)


@contextlib.contextmanager
def temporary() -> Iterator[list[DataFrame]]:
    """Tables that this thread stages within are deleted at its end, but for those that were put into the list that it gives."""
    kept: list[DataFrame] = []
    made: list[str] = []
    _scopes.open = [*getattr(_scopes, "open", ()), made]
    try:
        yield kept
    finally:
        _scopes.open = _scopes.open[:-1]
        stay = {getattr(table, "_staged_path", None) for table in kept}
        for path in made:
            if path in _staged and path not in stay:
                _remove(_staged.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _remove_staged() -> None:
    for path, spark in _staged.items():
        try:
            _remove(spark, path)
        except Exception:  # the JVM may be gone already; the folder is then left to its owner
            return


atexit.register(_remove_staged)
