"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators count on; everything about sizing stays with the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


_FALLBACK = "chatlake.shared.folder"
#: Paths that `materialise` wrote and nobody has deleted.
_WRITTEN: list[str] = []


def local_session(cores: int | str = "*", *, shuffle_partitions: int = 8, memory: str = "8g",
                  app: str = "chatlake") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where it is unset, local mode gets a temporary folder; a cluster must name
    one, as its executors do not share local folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_FALLBACK, None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="chatlake-")
        spark.conf.set(_FALLBACK, folder)
    return folder


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage by writing to the shared folder, so that a lost executor costs one re-read. `discard` deletes what was written."""
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN.append(path)
    out._scratch = path
    return out


def _file_system(spark: SparkSession, path: str):
    """(file system, path) as Hadoop's own objects."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = _file_system(spark, path)
    return system.exists(folder)


def is_folder(spark: SparkSession, path: str) -> bool:
    system, folder = _file_system(spark, path)
    return system.exists(folder) and system.getFileStatus(folder).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all below it, if it is there."""
    system, folder = _file_system(spark, path)
    system.delete(folder, True)


def _delete(spark: SparkSession, path: str) -> None:
    remove(spark, path)
    _WRITTEN.remove(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that `materialise` returned. Only where nothing reads them any more: all that was derived from
    them has been written or collected."""
    for frame in frames:
        path = getattr(frame, "_scratch", None)
        if path in _WRITTEN:
            _delete(frame.sparkSession, path)


def written() -> list[str]:
    """Folders that `materialise` wrote and nobody has deleted."""
    return list(_WRITTEN)


def discard_path(spark: SparkSession, path: str) -> None:
    """As `discard`, by the folder; nothing happens if it is gone."""
    if path in _WRITTEN:
        _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what `materialise` writes inside the block, but for the frames that are passed to the function it gives."""
    before, kept = set(_WRITTEN), set()

    def keep(frame: DataFrame) -> DataFrame:
        kept.add(frame._scratch)
        return frame

    try:
        yield keep
    finally:
        for path in [p for p in _WRITTEN if p not in before and p not in kept]:
            _delete(spark, path)
