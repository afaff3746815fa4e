"""Retrieval-quality metrics over (query_id, rank, filename) results and (query_id, relevant, k) cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked_files(results: DataFrame) -> DataFrame:
    """(query_id, files): filenames in rank order."""
    own = results.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "filename"))).alias("r"))
    return own.select("query_id", F.transform("r", lambda x: x["filename"]).alias("files"))


def _top(k: int | Column) -> Column:
    return F.slice("files", 1, k)


def _hits(top: Column) -> Column:
    return F.filter(top, lambda f: F.array_contains(F.col("relevant"), f))


def _recall(top: Column) -> Column:
    return F.when(F.size("relevant") == 0, 1.0).otherwise(F.size(F.array_distinct(_hits(top))) / F.size("relevant"))


def status(recall: Column, precision: Column) -> Column:
    return (
        F.when(recall == 0, "critical_fail")
        .when((recall >= 0.85) & (precision >= 0.45), "strong_pass")
        .when((recall >= 0.75) & (precision >= 0.35), "pass")
        .when((recall >= 0.60) & (precision >= 0.20), "weak_pass")
        .otherwise("fail")
    )


def _ndcg(k: int) -> Column:
    top = _top(k)
    gain = F.transform(top, lambda f, i: F.when(F.array_contains(F.col("relevant"), f) & (F.array_position(top, f) == i + 1), 1 / F.log2(i + 2.0)).otherwise(0.0))
    ideal = F.transform(F.sequence(F.lit(1), F.least(F.size("relevant"), F.lit(k))), lambda i: 1 / F.log2(i + 1.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size("relevant") == 0, 1.0).otherwise(total(gain) / total(ideal))


def metrics(results: DataFrame, cases: DataFrame) -> DataFrame:
    """One row a case: recall and precision at k, 5 and 10, top-1 and top-3 accuracy, MRR, nDCG and status."""
    df = cases.withColumn("relevant", F.array_distinct("relevant")).join(ranked_files(results), "query_id", "left")
    df = df.withColumn("files", F.coalesce("files", F.array().cast("array<string>")))
    at_k = _top(F.col("k"))
    first = F.coalesce(F.array_min(F.transform(_hits(_top(10)), lambda f: F.array_position(_top(10), f))), F.lit(0))
    df = df.select(
        "query_id", "relevant", "files",
        _recall(at_k).alias("recall_at_k"), (F.size(F.array_distinct(_hits(at_k))) / F.col("k")).alias("precision_at_k"),
        *[_recall(_top(n)).alias(f"recall_at_{n}") for n in (5, 10)], *[(F.size(_hits(_top(n))) / n).alias(f"precision_at_{n}") for n in (5, 10)],
        (F.size(_hits(_top(1))) > 0).cast("int").alias("top1"), (F.size(_hits(_top(3))) > 0).cast("int").alias("top3"),
        F.when(first > 0, 1 / first).otherwise(0.0).alias("mrr_at_10"), _ndcg(10).alias("ndcg_at_10"),
    ).withColumn("status", status(F.col("recall_at_k"), F.col("precision_at_k")))
    numbers = [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, 2) for c in numbers})


def nearest_rank(values: Column, p: float) -> Column:
    """The nearest-rank percentile of an array."""
    s = F.sort_array(values)
    at = F.greatest(F.lit(1), F.ceil(F.size(values) * (p / 100)).cast("int"))
    return F.when(F.size(values) > 0, F.get(s, at - 1)).otherwise(0.0)


def percentiles(rows: DataFrame, by: str, value: str, ps: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """(by, n, mean, p50, ...): nearest-rank percentiles by position: a sort in each group's window, without gathering its values."""
    w = W.partitionBy(by)
    at = rows.select(by, F.col(value).alias("_v")).withColumn("_at", F.row_number().over(w.orderBy("_v"))).withColumn("_of", F.count("*").over(w))
    own = [F.max(F.when(F.col("_at") == F.greatest(F.lit(1), F.ceil(F.col("_of") * p / 100)), F.col("_v"))).alias(f"p{p}") for p in ps]
    return at.groupBy(by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), *own)


def quality_index(recall: Column, p95_ms: Column) -> Column:
    latency = F.greatest(F.lit(0.0), 100 - p95_ms / 5)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(0.7 * recall * 100 + 0.3 * latency, 1)))


def graph_metrics(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row. Coverage is the share of edges that carry evidence."""
    shown = F.col("edge_type").isin("shared_anchor", "shared_entity", "manifest_overlap")
    e = edges.agg(F.count("*").alias("edges"), F.count(F.when(shown, 1)).alias("evidence_edges"))
    df = chunks.agg(F.count("*").alias("chunks")).crossJoin(e)  # one row each
    per = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 2)).otherwise(0.0)
    return df.select("chunks", "edges", "evidence_edges", per("edges", "chunks").alias("edges_per_chunk"), per("evidence_edges", "chunks").alias("visible_edges_per_node"), per("evidence_edges", "edges").alias("evidence_coverage"))


def false_positive_profile() -> Column:
    vec, lex, graph, ent = map(F.col, ("score_vec", "score_bm25", "score_graph", "score_entity"))
    return F.when(graph >= 0.5, "graph_assisted").when((vec > 0) & (lex == 0) & (graph == 0) & (ent == 0), "vector_only").when((lex > 0) | (ent > 0), "lexical_entity").otherwise("other")


def decide(before: dict[str, Column], after: dict[str, Column]) -> Column:
    """keep, revert or needs_more_data, from metrics before and after a change."""
    worse = (after["leakage"] > 0) | (after["critical"] > before["critical"]) | (after["recall"] < before["recall"] - 0.03) | (after["p95"] > 500)
    better = (after["precision"] - before["precision"] >= 0.05) | (after["aqi"] - before["aqi"] >= 2) | (after["coverage"] - before["coverage"] >= 0.10) | F.coalesce(after["visible"] <= 15, F.lit(False))
    return F.when(worse, "revert").when(better, "keep").otherwise("needs_more_data")


def gated_index(aqi: Column, leakage: Column, critical: Column, coverage: Column, crashed: Column) -> Column:
    """The index under its hard gates."""
    cap = lambda bad, most: F.when(bad, F.lit(float(most))).otherwise(F.lit(100.0))
    return F.least(aqi, cap(leakage > 0, 50), cap(critical > 0, 80), cap(coverage < 0.8, 75), cap(crashed, 70))


#: Goals: metric, target, and whether it is a lower bound.
GOALS = (("aqi", 85.0, True), ("recall_at_10", 0.92, True), ("precision_at_10", 0.45, True), ("p95_ms", 500.0, False), ("p99_ms", 900.0, False))


def goal_checks(summary: DataFrame) -> DataFrame:
    """(metric, actual, target, passed) of a one-row summary; a missing figure gives null."""
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("actual"), F.lit(t).alias("target"), (F.col(m) >= t if low else F.col(m) <= t).alias("passed")) for m, t, low in GOALS]
    return summary.select(F.inline(F.array(*rows)))


def diagnose(cases: DataFrame, documents: DataFrame, chunks: DataFrame, candidates: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, filename, stage): where the evidence of a relevant file was lost: indexing, chunking, candidates, ranking or not at all."""
    want = cases.select("query_id", F.explode("relevant").alias("filename"))
    docs = documents.select("filename", "doc_id", "status")
    cut = chunks.select("doc_id").distinct().withColumn("cut", F.lit(True))
    files = docs.join(cut, "doc_id", "left")
    met = candidates.select("query_id", "filename").distinct().withColumn("met", F.lit(True))
    top = results.select("query_id", "filename").distinct().withColumn("top", F.lit(True))
    df = want.join(files, "filename", "left").join(met, ["query_id", "filename"], "left").join(top, ["query_id", "filename"], "left")
    stage = F.when(F.col("top"), "found").when(F.col("doc_id").isNull(), "not_indexed").when(F.col("status") != "indexed", "not_visible").when(F.col("cut").isNull(), "no_chunks").when(F.col("met").isNull(), "no_candidate").otherwise("ranked_out")
    return df.select("query_id", "filename", stage.alias("stage"))
