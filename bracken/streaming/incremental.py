"""Extension: a folder as a stream of files, indexed batch by batch as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import doc_class, filename, format_of, is_engine_output, is_supported
from ..plans.engine import Engine
from ..sources.parse import sidecars


def watch_folder(engine: Engine, workdir: str, folder: str, checkpoint: str, max_files: int = 1000):
    """A started query; trigger: whatever has arrived. A batch that is run again finds its files indexed and skips them."""
    spark = engine.spark
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(folder)
    own = files.where(is_supported(F.col("path")) & ~is_engine_output(F.col("path")))
    own = own.select("path", filename(F.col("path")).alias("filename"), format_of(F.col("path")).alias("format"), doc_class(F.col("path")).alias("doc_class"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), "content")

    def index(batch: DataFrame, _: int) -> None:
        engine.index_files(workdir, batch, sidecars(spark, folder))

    return own.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Events by type and window of time; works on a stream (with late data up to `late`) and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")
