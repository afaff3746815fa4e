"""Mixing sources to target weights: tokens per source, repetition rates, floor(rate) copies and one seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: Seeds tried for each source; the one whose draws come nearest to the target is used.
SEEDS = 16


def _uniform(seed: Column) -> Column:
    """A number in [0, 1) from a row's key and a seed: the same in every run."""
    return F.pmod(F.xxhash64(F.lit("mix"), seed, F.col("_key")), F.lit(1 << 30)) / float(1 << 30)


def source_targets(per_source: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, tokens) with weight and target; null sources last, targets at most `most` times the tokens.

    The water level: sources in order of most * tokens / weight; one stops at its limit exactly if what is left for
    it and the later ones, shared by weight, is above that limit. One row a source, so one window holds them.
    """
    code_points = W.orderBy(F.col("source").isNull(), F.col("source"))
    k = F.row_number().over(code_points) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (k % len(weights) + 1).cast("int"))
    s = per_source.withColumn("weight", w).withColumn("limit", most * F.col("tokens"))
    by_ratio = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    sofar = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    s = s.withColumns({"level": (share * F.sum("tokens").over(everything) - F.coalesce(F.sum("limit").over(sofar), F.lit(0.0))) / F.sum("weight").over(rest)})
    s = s.withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    first = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(W.unboundedPreceding, W.currentRow))
    return s.select("source", "tokens", "weight", F.when(first.isNull(), F.col("limit")).otherwise(F.least(first * F.col("weight"), F.col("limit"))).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """Each row with size, source_size, target and `copies`: how often the mix takes it.

    A null text has no words and a null source is a source of its own, the last one. A source without words has the
    target 0. The draw of a row depends on its id and text, so rows without an id are drawn one by one, and only rows
    that repeat both are drawn alike. An empty table gives no rows. keep: with all columns of docs (under a struct
    `row`, so that none can clash), else with its id only.

    A row gets floor(rate) copies and one more if a hash of its key and the source's seed falls below the fraction:
    with that probability, for any seed. The seed is the one of SEEDS whose draws come nearest to the source's target;
    which it is depends on the hashes of all rows together, and hardly on a single one's.
    """
    def sized(*more: Column) -> DataFrame:
        return docs.select(*more, F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("_key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))

    base = staged(sized(), "mix")  # the words are counted once
    per_source = base.groupBy("source").agg(F.sum("size").alias("tokens"))
    targets = source_targets(per_source, weights, share, most)
    rate = F.when(F.col("tokens") > 0, F.col("target") / F.col("tokens")).otherwise(F.lit(0.0))
    targets = targets.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    # One row a source: broadcast where Spark finds it small enough, else a join that AQE splits at hot sources.
    def with_targets(df: DataFrame, t: DataFrame) -> DataFrame:
        t = t.withColumnRenamed("source", "_source")
        return df.join(t, df["source"].eqNullSafe(t["_source"])).drop("_source")

    drawn = with_targets(base.select("_key", "source", "size"), targets.select("source", "part"))
    tries = [F.sum(F.when(_uniform(F.lit(k)) < F.col("part"), F.col("size")).otherwise(0)).alias(f"try{k}") for k in range(SEEDS)]
    tries = drawn.groupBy("source").agg(*tries).withColumnRenamed("source", "_source")
    chosen = targets.join(tries, targets["source"].eqNullSafe(tries["_source"])).drop("_source")
    miss = F.array_min(F.array(*[F.struct(F.abs(F.col(f"try{k}") - F.col("part") * F.col("tokens")), F.lit(k).alias("seed")) for k in range(SEEDS)]))
    chosen = chosen.select("source", "tokens", "target", "whole", "part", miss["seed"].alias("seed"))
    out = with_targets(sized(F.struct("*").alias("row")) if keep else base, chosen)
    copies = F.col("whole") + F.when(_uniform(F.col("seed")) < F.col("part"), 1).otherwise(0)
    return out.select("row" if keep else F.col("_id").alias(id_col), "size", F.col("tokens").alias("source_size"), "target", copies.cast("long").alias("copies"))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself, from mix_sources(keep=True): each document as often as it is taken."""
    return mixed.where("copies > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_k")).select("row.*")
