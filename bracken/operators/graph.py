"""Graph queries: neighbours with evidence, overview, and breadth-first neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import snippet
from ..plans.staging import staged
from .edges import symmetric

MOST_NODES = 500
#: Kinds of edges that can have evidence.
TOLD = ["semantic", "shared_anchor", "manifest_overlap", "shared_entity"]


def evidence(edge_type: Column, reason: Column, src: Column, dst: Column) -> Column:
    """(kind, anchor, src_span, dst_span) or null: what a reader can check in both texts."""
    prefix = F.when(edge_type == "shared_anchor", "anchor:").when(edge_type == "manifest_overlap", "manifest:")
    literal = F.when(edge_type == "shared_entity", F.regexp_extract(reason, "(?s)^[^:]*:(.*)$", 1)).when(F.startswith(reason, prefix), F.substring(reason, F.length(prefix) + 1, F.length(reason)))
    kind = F.when(edge_type == "manifest_overlap", "manifest").otherwise(edge_type)
    none = F.lit(None).cast("string")
    told = F.struct(kind.alias("kind"), literal.alias("anchor"), snippet(src, literal).alias("src_span"), snippet(dst, literal).alias("dst_span"))
    plain = F.struct(F.lit("semantic").alias("kind"), none.alias("anchor"), none.alias("src_span"), none.alias("dst_span"))
    return F.when(edge_type == "semantic", plain).when(literal.isNotNull() & ((edge_type != "shared_entity") | reason.contains(":")), told)


def neighbors(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, documents: DataFrame, limit: int) -> DataFrame:
    """For each chunk_id of nodes its heaviest edges: (node, rank, chunk_id, ..., evidence). A limit of 0 gives nothing."""
    own = symmetric(edges).join(nodes.select(F.col("chunk_id").alias("node")), "node", "left_semi")
    meta = chunks.join(documents.select("doc_id", "filename", "doc_class"), "doc_id").select("chunk_id", "doc_id", "filename", "doc_class", "chunk_signal", "content")
    order = W.partitionBy("node").orderBy(F.desc("weight"), "other")
    # The other end must exist before it takes a place.
    own = own.join(meta, own["other"] == meta["chunk_id"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    origin = chunks.select(F.col("chunk_id").alias("node"), F.col("content").alias("origin"))
    out = own.join(origin, "node")
    return out.select("node", "rank", "chunk_id", "doc_id", "filename", "doc_class", "chunk_signal", "weight", "edge_type", "reason", evidence(F.col("edge_type"), F.col("reason"), F.col("origin"), F.col("content")).alias("evidence"))


def degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("node").alias("chunk_id")).agg(F.count("*").alias("degree"))


def by_degree(edges: DataFrame, limit: int) -> DataFrame:
    """(chunk_id, degree): the chunks of the most edges, ties to the smaller id."""
    return degrees(edges).orderBy(F.desc("degree"), "chunk_id").limit(limit)


#: The order in which a drawing shows kinds of links, and how many nodes and links it has room for.
LINK_ORDER, SHOWN_NODES, SHOWN_LINKS = ("shared_anchor", "shared_entity", "semantic", "semantic_topk", "manifest_overlap"), 160, 520


def shown_links(edges: DataFrame, limit: int = SHOWN_LINKS) -> DataFrame:
    """The links that a drawing shows, with type_rank: the kinds that say most first, then the heaviest."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LINK_ORDER)), F.col("edge_type")), F.lit(0)), F.lit(len(LINK_ORDER) + 1)).cast("int")
    return edges.withColumn("type_rank", rank).orderBy("type_rank", F.desc("weight"), "src_chunk", "dst_chunk").limit(limit)


def with_documents(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """edges between chunks that exist, with src_doc and dst_doc."""
    end = lambda name: chunks.select(F.col("chunk_id").alias(f"{name}_chunk"), F.col("doc_id").alias(f"{name}_doc"))
    return edges.join(end("src"), "src_chunk").join(end("dst"), "dst_chunk").select(*edges.columns, "src_doc", "dst_doc")


def node_rows(ids: DataFrame, edges: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """ids (chunk_id, ...) with doc_id, filename, class, signal and degree."""
    meta = chunks.join(documents.select("doc_id", "filename", "doc_class"), "doc_id").select("chunk_id", "doc_id", "filename", "doc_class", "chunk_signal")
    return ids.join(meta, "chunk_id").join(degrees(edges), "chunk_id", "left").fillna(0, ["degree"])


def overview(edges: DataFrame, chunks: DataFrame, documents: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The content chunks of the highest degree, and the edges among them."""
    content = chunks.where("chunk_signal = 'content'").join(documents.where("doc_class = 'content'").select("doc_id"), "doc_id", "left_semi")
    nodes = node_rows(content.select("chunk_id"), edges, chunks, documents).orderBy(F.desc("degree"), "chunk_id").limit(limit)
    return nodes, edges_among(nodes, edges)


def edges_among(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("chunk_id")
    own = edges.join(ids.withColumnRenamed("chunk_id", "src_chunk"), "src_chunk", "left_semi")
    return own.join(ids.withColumnRenamed("chunk_id", "dst_chunk"), "dst_chunk", "left_semi").select(*edges.columns)


def neighborhood(seeds: DataFrame, edges: DataFrame, depth: int, limit: int = 160) -> DataFrame:
    """(chunk_id, depth): nodes within `depth` steps of the seeds (chunk_id), the nearest first.

    A frontier meets the edges in one join a step. The cap keeps nearer nodes, then those of the heavier edge, then
    the smaller id; seeds stay even beyond it.
    """
    most = min(max(limit, 1), MOST_NODES)
    both = symmetric(edges).select("node", "other", "weight")
    seen = seeds.select("chunk_id").distinct().withColumn("depth", F.lit(0)).withColumn("weight", F.lit(float("inf")))
    front = seen
    for step in range(1, depth + 1):
        met = front.join(both.withColumnRenamed("weight", "w"), front["chunk_id"] == both["node"]).groupBy(F.col("other").alias("chunk_id")).agg(F.max("w").alias("weight"))
        front = staged(met.join(seen.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.lit(step).alias("depth"), "weight"), "front")
        seen = seen.unionByName(front)
    top = seen.orderBy("depth", F.desc("weight"), "chunk_id").limit(most).unionByName(seen.where("depth = 0")).distinct()
    return top.select("chunk_id", "depth")
