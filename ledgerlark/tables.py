"""Tables in the shared folder that end a lineage, so that any executor can read them again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_folder: ContextVar[str | None] = ContextVar("folder of tables", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where spark.checkpoint.dir is unset, a session within one process (as in tests) gets a folder of
    its own; on a cluster, whose executors would not share one, that is an error."""
    context = spark.sparkContext
    found = context.getCheckpointDir()
    if found is None:
        told = context.getConf().get("spark.checkpoint.dir")
        if told is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is unset: tables that end a lineage need a folder that all executors share")
        context.setCheckpointDir(told or tempfile.mkdtemp(prefix="checkpoint-"))
        found = context.getCheckpointDir()
    return found


def _written(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder wherever Spark reads; False if there is none."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True))


def saved(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder, or to that of the scratch() around: its lineage ends there, and a join with it
    knows its size, so that Spark sends it to all tasks where that is below its own threshold."""
    return _written(df, _folder.get() or shared_dir(df.sparkSession))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that saved() writes within are deleted at the end; the function that is given writes a result that stays."""
    outer = _folder.get() or shared_dir(spark)
    own = f"{outer}/{uuid.uuid4().hex}"
    token = _folder.set(own)
    try:
        yield lambda df: _written(df, outer)
    finally:
        _folder.reset(token)
        deleted(spark, own)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that saved() wrote and nothing reads any more."""
    for path in {p.rpartition("/")[0] for p in df.inputFiles()}:
        deleted(df.sparkSession, path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path; None where there is none or it has no files."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
