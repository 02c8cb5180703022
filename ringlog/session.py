"""Session for local runs, and the shared folder for written tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests and the benchmark only."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ringlog")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("RINGLOG_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="ringlog-")


def work_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, in the folder named by spark.checkpoint.dir.

    All executors must share that folder. Where it is unset, a local session, whose
    executors are threads of this process, gets a folder of its own; on a cluster
    that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    """A path's file system and the path, whatever store it is in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    system, file = _file(spark, path)
    return system.exists(file)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in a folder, none if there is no such folder."""
    system, file = _file(spark, path)
    found = system.listStatus(file) if system.exists(file) else []
    return sorted(status.getPath().getName() for status in found if status.isDirectory())


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written."""
    system, file = _file(spark, path)
    system.delete(file, True)


def read_note(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, if it is there."""
    system, file = _file(spark, path)
    if not system.exists(file):
        return None
    stream = system.open(file)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def read_head(spark: SparkSession, path: str, size: int) -> bytes:
    """The first bytes of a file."""
    system, file = _file(spark, path)
    stream = system.open(file)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there as a whole or not at all: written aside, then renamed."""
    system, aside = _file(spark, f"{path}-{uuid.uuid4().hex}")
    stream = system.create(aside)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    _, file = _file(spark, path)
    if not system.rename(aside, file):
        raise OSError(f"could not write {path}")
