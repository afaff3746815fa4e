"""Written intermediate tables: computed once, read by many, and safe when an executor is lost."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: The folder of the work in progress below the application's, if it has one of its own.
_SCRATCH: ContextVar[str] = ContextVar("scratch", default="")


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that all executors see: spark.checkpoint.dir.

    Where that is unset, a local master has a temporary folder; a cluster must name one.
    """
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        told = "file://" + os.path.join(tempfile.gettempdir(), "bracken")
    return f"{told}/{spark.sparkContext.applicationId}{_SCRATCH.get()}"


def staged(df: DataFrame, label: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Deletes all that this application has staged; call it when the results that were made from it are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end: for work that writes its results itself."""
    token = _SCRATCH.set(f"{_SCRATCH.get()}/work-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        clear_staged(spark)
        _SCRATCH.reset(token)
