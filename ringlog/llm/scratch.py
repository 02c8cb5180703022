"""Cutting lineage with rows written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="ringlog-llm-")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(frame: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder; the files go when nothing refers to them."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows as Parquet: smaller than a checkpoint, and read by column."""
    path = new_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def remove(frame: DataFrame) -> None:
    """Delete the files of a written frame that nothing will read again."""
    jvm = frame.sparkSession._jvm
    conf = frame.sparkSession._jsc.hadoopConfiguration()
    for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def free_name(frame: DataFrame, name: str) -> str:
    """The name, with underscores after it until no column of the frame has it."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
