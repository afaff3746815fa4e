"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words, as a Java / RE2 / Python character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below the one that all executors see: spark.checkpoint.dir.

    Where that is unset, a local master has a temporary folder; a cluster must name one.
    """
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not told:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        told = "file://" + os.path.join(tempfile.gettempdir(), "bracken")
    return f"{told}/{spark.sparkContext.applicationId}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Has the driver drop what finished plans held. Their handles keep shuffle files and broadcasts alive on the executors,
    until the driver's memory is collected, which a driver with little work does late."""
    spark.sparkContext._jvm.System.gc()


def clear_staged(spark: SparkSession) -> None:
    """Deletes all that this application has staged; call it when the results that were made from it are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots as __) for what is planned and run inside; the old ones come back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def inline_rows(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A small driver-side table of known size as a JVM-side literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def let(value: Column, body) -> Column:
    """body(value), where value is evaluated once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case only; other letters stay. Plain ASCII takes the fast path."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows of text that go to a Python worker at once.
TEXT_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so batches of the usual 10,000 rows would fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def give_back() -> None:
    """Returns a Python worker's free memory to the system; workers are used again and share an executor's limit."""
    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def scan_groups(rows: DataFrame, keys: list[str], run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run(rows of a key, as a table) for each key. A partition is read in key order, so only one group and batch are held."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            if not table.num_rows:
                continue
            own = np.stack([table.column(k).to_numpy() for k in keys])
            edge = np.flatnonzero(np.r_[True, (own[:, 1:] != own[:, :-1]).any(axis=0)])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                yield from run(table.slice(a, b - a))
            rest = table.slice(int(edge[-1]))
        if rest is not None and rest.num_rows:
            yield from run(rest)
        give_back()

    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(scan, schema)
