"""Line deduplication over levelled sorted runs of line hashes.

A run is a table (h1, h2, n): 128 bits of hash for each line key and in how many documents of its batches it was
found. It is bucketed by the key and each bucket is one sorted file, so that runs meet each other, and a batch meets
the runs, by merging sorted files: neither is exchanged or sorted again. Each new batch is counted, merge-anti-joined
with the keys that the runs already know to be frequent (nothing more can change for them) and added as a run of level
0; `fanout` runs of a level are merged into one of the next. So a key's counts are rewritten a logarithmic number of
times, however many batches come.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, settings, shared_dir, staged, tidy

#: Sorted buckets are read as sorted.
SORTED = {"spark__sql__legacy__bucketedTableScan__outputOrdering": "true"}


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_keys(text: Column, min_chars: int) -> Column:
    """For each line (h1, h2) of its stripped, A-Z lower-cased key; null for keys under min_chars code points."""
    keys = F.transform(lines_of(text), lambda x: ascii_lower(F.btrim(x, F.lit(SPACE_CHARS))))
    return F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("second"), k).alias("h2"))))


class LineRuns:
    """The store. `levels` holds the runs, lowest level first; every run is a bucketed table in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        # As many buckets as an exchange has partitions, so that a counted batch lies as the runs do.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def _frequent(self, run: DataFrame) -> DataFrame:
        return run.where(F.col("n") >= self.min_docs).select("h1", "h2")

    def frequent(self) -> DataFrame:
        """The keys in at least min_docs documents. After compact(), when one run holds all counts."""
        runs = self._runs()
        return self._frequent(runs[0]) if runs else self.spark.range(0).selectExpr("id as h1", "id as h2")

    def write(self, counts: DataFrame) -> DataFrame:
        """counts (h1, h2, n), a row a key, as a run. The table is taken from the catalog again; its files stay."""
        name = f"line_run_{uuid.uuid4().hex}"
        with settings(self.spark, **SORTED):
            counts.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", f"{shared_dir(self.spark)}/{name}").saveAsTable(name)
        run = self.spark.table(name)
        run.schema  # analysed while the table has a name
        self.spark.sql(f"drop table {name}")
        return run

    def _put(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(self.write(merged(runs)), level + 1)

    def fresh(self, counts: DataFrame) -> DataFrame:
        """Of a counted batch the keys that no run knows to be frequent: one merging anti-join for each run."""
        for run in self._runs():
            counts = counts.join(self._frequent(run).hint("merge"), ["h1", "h2"], "left_anti")
        return counts

    def add(self, keys: DataFrame) -> None:
        """A batch: (h1, h2), a row for each document and distinct key. Counted before and after the exchange, so that a key of all documents is a few rows."""
        self._put(self.write(self.fresh(keys.groupBy("h1", "h2").agg(F.count("*").alias("n")))), 0)

    def new_keys(self, keys: DataFrame) -> DataFrame:
        """The distinct keys of a batch that no run holds: first-seen deduplication across batches."""
        keys = keys.select("h1", "h2").distinct()
        for run in self._runs():
            keys = keys.join(run.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def compact(self) -> None:
        """Merges all runs into one."""
        runs = self._runs()
        if len(runs) > 1:
            self.levels = [[] for _ in self.levels[1:]] + [[self.write(merged(runs))]]


def merged(runs: list[DataFrame]) -> DataFrame:
    """One run of several: sorted files are merged, the counts of equal keys added."""
    out = runs[0]
    for run in runs[1:]:
        other = run.select("h1", "h2", F.col("n").alias("m"))
        both = out.join(other.hint("merge"), ["h1", "h2"], "full_outer")
        out = both.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
    return out


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `kept_text`, `n_lines` and `n_dropped`: lines whose key min_docs or more documents have are gone.

    Each row counts as a document, also one that repeats another or has no id. A null or empty text is one empty line
    and stays empty; keys under min_chars stay and aren't counted. If all lines go, the text is empty. All columns of
    docs are returned as they are, but for any with the names of the three new ones, which are replaced. A table
    that is here at once is fed to the runs in `batches` parts, each of which is read by itself.
    """
    text, spark = F.col(text_col), docs.sparkSession
    keys = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), line_keys(text, min_chars).alias("keys"))
    path = f"{shared_dir(spark)}/line-keys-{uuid.uuid4().hex}"
    keys.withColumn("batch", F.pmod(F.xxhash64("id", "th"), F.lit(batches))).write.partitionBy("batch").parquet(path)
    # Rows that are alike in id and text share a batch, which changes no count.
    keys = spark.read.schema(keys.schema.add("batch", "long")).parquet(path)
    runs = LineRuns(spark, min_docs)
    for k in range(batches):
        one = keys.where(F.col("batch") == k).select(F.explode(F.array_distinct("keys")).alias("k")).where("k is not null")
        runs.add(one.select("k.h1", "k.h2"))
    runs.compact()
    # As a plain table: the join below is with all lines, and a line of most documents must be split, which buckets forbid.
    frequent = staged(runs.frequent(), "line-frequent")
    tidy(spark)
    # The places of the lines to drop, by document; the hash of the text tells rows with the same id apart.
    lines = keys.select("id", "th", F.posexplode("keys").alias("pos", "k")).where("k is not null").select("id", "th", "pos", "k.h1", "k.h2")
    drops = lines.join(frequent, ["h1", "h2"]).groupBy("id", "th").agg(F.collect_set("pos").alias("drops"))
    same = docs[id_col].eqNullSafe(drops["id"]) & (F.xxhash64(docs[text_col]) == drops["th"])
    out = docs.join(drops, same, "left").select(docs["*"], drops["drops"].alias("_drops"))
    out = out.withColumn("n_lines", F.size(lines_of(text)).cast("long"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines_of(text)) - 1), F.col("_drops"))
    left = F.array_join(_pick(lines_of(text), stay), "\n")
    return out.withColumn("kept_text", F.when(F.col("_drops").isNull(), F.coalesce(text, F.lit(""))).otherwise(left)).withColumn("n_dropped", F.coalesce(F.size("_drops"), F.lit(0)).cast("long")).drop("_drops")


def _pick(items: Column, places: Column) -> Column:
    """The items at the places, in one pass."""
    return F.transform(F.array(F.struct(items.alias("i"), places.alias("p"))), lambda s: F.transform(s["p"], lambda p: s["i"][p]))[0]
