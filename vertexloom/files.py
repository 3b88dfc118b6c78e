"""Files outside of Spark's tables: where they are, and scratch folders that go when the program ends."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from vertexloom.session import ensure_checkpoint_dir

_made: list[str] = []


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there; a path without a scheme is local."""
    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        return (fs.LocalFileSystem(), "/" + rest.lstrip("/")) if scheme == "file" else fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def readable(path: str) -> bool:
    """Whether pyarrow knows the path's file system; some only Spark can read."""
    try:
        located(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def discard(path: str) -> None:
    """Delete a folder that is not needed any more; on a file system that only Spark knows it stays."""
    if readable(path):
        system, folder = located(path)
        with contextlib.suppress(OSError):  # gone already, or in use by what ends just now
            system.delete_dir(folder)


def scratch(spark: SparkSession) -> str:
    """A new folder's name below the shared checkpoint folder; results may read it until the program ends."""
    path = f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Spark's setting by which a command deletes what it shuffled when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Commands within delete what they shuffled when they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written in a scratch folder as compressed columns and read from there.

    It takes less disk than a checkpoint of the same rows, and what was shuffled for it is deleted at once.
    """
    path = scratch(df.sparkSession)
    with shuffles_go(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def only_last(kept: int = 1) -> Iterator[None]:
    """Of the scratch folders that are made within, only the last so many stay; the others are deleted at its end."""
    known = len(_made)
    yield
    gone = _made[known : max(known, len(_made) - kept)]
    for path in gone:
        discard(path)
    del _made[known : known + len(gone)]


@atexit.register
def _discard_all() -> None:
    for path in _made:
        for suffix in ("", ".wel", ".updates", ".staged"):
            discard(path + suffix)
