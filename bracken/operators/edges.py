"""Edge builders of the chunk graph, and the merge of their results.

Documents link to those that arrived before them: `arrival` numbers them. Where a fan-out is limited, the earliest
matches are taken, which lets a hot value be cut to its first rows before the join instead of after it.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..plans.staging import staged

SAME_DOC, SEMANTIC, SEMANTIC_FLOOR, SEMANTIC_MOST = 0.5, 0.62, 0.45, 5
ANCHOR, MANIFEST = 0.9, 0.3
SHARED = {"DATE": 0.60, "PROPER": 0.65, "PHRASE": 0.70}
FANOUT, DOC_FRACTION = 8, 0.5
#: Vectors of a block, rows of it that are multiplied at once, and arrivals that one task counts of a value.
BLOCK, SLICE, COUNTED = 4096, 256, 1 << 16
COLUMNS = ("src_chunk", "dst_chunk", "weight", "edge_type", "reason")


def arrivals(documents: DataFrame, *order: str) -> DataFrame:
    """documents with `arrival` 1, 2, ...: ranks inside ranges, plus the counts of the ranges before, so no task sorts all.

    The ranges are written once: what counts them and what ranks in them must see the same ones.
    """
    spread = staged(documents.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "arrivals")
    own = spread.withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    sizes = own.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    return own.join(F.broadcast(before), "_part").withColumn("arrival", F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")


def canonical(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b).alias("src_chunk"), F.greatest(a, b).alias("dst_chunk")


def cos_reason(sim: Column) -> Column:
    return F.concat(F.lit("cos:"), F.format_string("%.2f", F.round(sim, 2)))


def same_doc(chunks: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All pairs of a document's content chunks. nodes (chunk_id): only pairs that touch these few."""
    own = chunks.where("chunk_signal = 'content'").select("doc_id", "chunk_id", "chunk_index")
    a, b = own.alias("a"), own.alias("b")
    if nodes is None:
        pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.chunk_index") < F.col("b.chunk_index")))
    else:
        a = F.broadcast(own.join(F.broadcast(nodes.select("chunk_id")), "chunk_id", "left_semi")).alias("a")
        pairs = b.join(a, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.chunk_index") != F.col("b.chunk_index")))
    ends = pairs.select(*canonical(F.col("a.chunk_id"), F.col("b.chunk_id")))
    return (ends if nodes is None else ends.distinct()).select("*", F.lit(SAME_DOC).alias("weight"), F.lit("same_doc").alias("edge_type"), F.lit("same_doc").alias("reason"))


def semantic_within(vectors: DataFrame) -> DataFrame:
    """Pairs of one document's vectors (doc_id, chunk_id, embedding) with cosine of SEMANTIC or more."""
    a, b = vectors.alias("a"), vectors.alias("b")
    pairs = a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.chunk_id") < F.col("b.chunk_id")))
    pairs = pairs.select(*canonical(F.col("a.chunk_id"), F.col("b.chunk_id")), cosine(F.col("a.embedding"), F.col("b.embedding")).alias("weight"))
    return pairs.where(F.col("weight") >= SEMANTIC).select("src_chunk", "dst_chunk", "weight", F.lit("semantic").alias("edge_type"), cos_reason(F.col("weight")).alias("reason"))


def _units(vectors: pd.Series) -> np.ndarray:
    m = np.stack(vectors.to_numpy())
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def top_neighbors(vectors: DataFrame, k: int = SEMANTIC_MOST, floor: float = SEMANTIC_FLOOR, among: DataFrame | None = None) -> DataFrame:
    """(chunk_id, other, sim): for each vector the k most similar ones of earlier documents (arrival), with at least `floor`.

    among: where these are looked for; by default in vectors. Exact, block against block: a task holds two blocks of
    BLOCK vectors at most, multiplies them in slices, and only the k best of each vector leave it. The blocks follow
    from the counts, so the work grows with the product of both sides and no task does.
    """
    columns = ["chunk_id", "arrival", F.col("embedding").cast("array<double>").alias("embedding")]

    def blocked(rows: DataFrame) -> tuple[DataFrame, int]:
        rows = staged(rows.where("embedding is not null").select(*columns), "near")
        count = rows.count()
        n = max(1, min(8, count // 256), -(-count // BLOCK))
        return rows.withColumn("own", F.pmod(F.xxhash64("chunk_id"), F.lit(n))), n

    left, a = blocked(vectors)
    right, b = (left, a) if among is None else blocked(among)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    def best(key: tuple, new: pd.DataFrame, old: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(new) and len(old):
            old = old.set_axis(["b", *new.columns[1:-1], "a"], axis=1).sort_values("chunk_id")
            width = old["embedding"].map(len).to_numpy()
            for n in set(new["embedding"].map(len)) & set(width):
                own, other = new[new["embedding"].map(len) == n], old[width == n]
                unit, ids, when = _units(other["embedding"]), other["chunk_id"].to_numpy(), other["arrival"].to_numpy()
                for at in range(0, len(own), SLICE):
                    part = own.iloc[at : at + SLICE]
                    sims = np.clip(_units(part["embedding"]) @ unit.T, 0, 1)
                    sims[when[None, :] >= part["arrival"].to_numpy()[:, None]] = -1
                    near = np.round(sims, 9)
                    # Stable on rows that are sorted by id: ties go to the smaller one.
                    order = np.argsort(-near, axis=1, kind="stable")[:, :k]
                    value = np.take_along_axis(sims, order, axis=1)
                    i, j = np.nonzero(value >= floor)
                    out.append(pd.DataFrame({"chunk_id": part["chunk_id"].to_numpy()[i], "other": ids[order[i, j]], "sim": value[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"chunk_id": [], "other": [], "sim": []}).astype({"chunk_id": "object", "other": "object", "sim": "float64"})

    left = left.select(F.col("own").alias("a"), "chunk_id", "arrival", "embedding", every(b).alias("b"))
    # Other names, as both sides may be one table.
    right = right.select(F.col("own").alias("b_"), *[F.col(c).alias(f"{c}_") for c in ("chunk_id", "arrival", "embedding")], every(a).alias("a_"))
    both = left.groupBy("a", "b").cogroup(right.groupBy("a_", "b_")).applyInPandas(best, "chunk_id string, other string, sim double")
    order = W.partitionBy("chunk_id").orderBy(F.desc(F.round("sim", 9)), "other")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def semantic_across(vectors: DataFrame, among: DataFrame | None = None) -> DataFrame:
    near = top_neighbors(vectors, among=among)
    kind = F.when(F.col("sim") >= SEMANTIC, "semantic").otherwise("semantic_topk")
    return near.select(*canonical(F.col("chunk_id"), F.col("other")), F.col("sim").alias("weight"), kind.alias("edge_type"), cos_reason(F.col("sim")).alias("reason"))


def _shared(entities: DataFrame, kinds: list[str], new: DataFrame) -> DataFrame:
    """Rows (chunk_id, other, entity_type, value): the first FANOUT matches in earlier documents of each row of `new`.

    entities: with arrival. Matches come in order of (arrival, chunk_id, seq), so a value's first FANOUT rows are all
    that any later row can get: a hot value is cut to them before the join.
    """
    first = first_matches(entities.where(F.col("entity_type").isin(kinds))).select("entity_type", "value", F.col("chunk_id").alias("other"), F.col("arrival").alias("earlier"))
    rows = new.where(F.col("entity_type").isin(kinds)).withColumn("value", F.coalesce("normalized_value", "value")) if "normalized_value" in new.columns else new
    return rows.select("chunk_id", "arrival", "entity_type", "value").join(first, ["entity_type", "value"]).where("earlier < arrival")


def content_entities(entities: DataFrame, chunks: DataFrame, documents: DataFrame, doc_class: str | None = "content") -> DataFrame:
    """Entity rows of content chunks of documents of a class, with arrival. entities may be the result for all classes, written once for many."""
    if "arrival" in entities.columns:
        return entities if doc_class is None else entities.where(F.col("doc_class") == doc_class)
    docs = documents if doc_class is None else documents.where(F.col("doc_class") == doc_class)
    own = chunks.where("chunk_signal = 'content'").select("chunk_id")
    return entities.join(own, "chunk_id", "left_semi").join(docs.select("doc_id", "doc_class", "arrival"), "doc_id")


def with_values_of(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of all values that link documents and that the nodes (chunk_id) hold, whoever holds them."""
    value = F.coalesce("normalized_value", "value")
    linking = entities.where(F.col("entity_type").isin(["ANCHOR", *SHARED]))
    held = linking.join(F.broadcast(nodes.select("chunk_id")), "chunk_id", "left_semi").select("entity_type", value.alias("_key")).distinct()
    return linking.withColumn("_key", value).join(F.broadcast(held), ["entity_type", "_key"], "left_semi").select(*entities.columns)


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with an end in nodes (chunk_id), which are different ones and few."""
    end = lambda name: F.broadcast(nodes.select(F.col("chunk_id").alias(name)))
    met = edges.join(end("_src"), F.col("src_chunk") == F.col("_src"), "left").join(end("_dst"), F.col("dst_chunk") == F.col("_dst"), "left")
    return met.where("_src is not null or _dst is not null").select(*edges.columns)


def first_matches(entities: DataFrame) -> DataFrame:
    """(entity_type, value, chunk_id, place): the first FANOUT rows of each value, in order of arrival. entities: with arrival."""
    own = entities.select("entity_type", F.coalesce("normalized_value", "value").alias("value"), "chunk_id", "arrival", "seq")
    place = F.row_number().over(W.partitionBy("entity_type", "value").orderBy("arrival", "chunk_id", "seq"))
    return own.withColumn("place", place).where(F.col("place") <= FANOUT).drop("seq")


def _of(rows: DataFrame, new: DataFrame | None) -> DataFrame:
    return rows if new is None else rows.join(new.select("doc_id"), "doc_id", "left_semi")


def _by_anchor(entities: DataFrame, chunks: DataFrame, documents: DataFrame, new: DataFrame | None, doc_class: str, weight: float, kind: str, prefix: str) -> DataFrame:
    own = content_entities(entities, chunks, documents, doc_class)
    hits = _shared(own, ["ANCHOR"], _of(own, new))
    return hits.select(*canonical(F.col("chunk_id"), F.col("other")), F.lit(weight).alias("weight"), F.lit(kind).alias("edge_type"), F.concat(F.lit(prefix), "value").alias("reason"))


def shared_anchor(entities: DataFrame, chunks: DataFrame, documents: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """new (doc_id): link these documents only, to all before them; by default all documents."""
    return _by_anchor(entities, chunks, documents, new, "content", ANCHOR, "shared_anchor", "anchor:")


def manifest_overlap(entities: DataFrame, chunks: DataFrame, documents: DataFrame, new: DataFrame | None = None) -> DataFrame:
    return _by_anchor(entities, chunks, documents, new, "reference", MANIFEST, "manifest_overlap", "manifest:")


def holders_so_far(holders: DataFrame) -> DataFrame:
    """holders (entity_type, value, arrival), different ones, with df: how many hold the value up to and including the arrival.

    Counted inside spans of COUNTED arrivals, plus the counts of the spans before: no task gets all holders of a hot value.
    """
    rows = holders.withColumn("_span", F.floor(F.col("arrival") / COUNTED))
    keys = ["entity_type", "value"]
    spans = rows.groupBy(*keys, "_span").agg(F.count("*").alias("_n"))
    before = spans.select(*keys, "_span", (F.sum("_n").over(W.partitionBy(*keys).orderBy("_span")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(*keys, "_span").orderBy("arrival"))
    return rows.withColumn("_in", inside).join(before, [*keys, "_span"]).select(*keys, "arrival", (F.col("_in") + F.col("_before")).alias("df"))


def shared_entity(entities: DataFrame, chunks: DataFrame, documents: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """Dates, proper nouns and phrases; values that more than half of the documents so far hold are skipped.

    How many documents hold a value counts those of every class, up to and including the new one.
    """
    kinds = list(SHARED)
    value = F.coalesce("normalized_value", "value").alias("value")
    every = content_entities(entities, chunks, documents, None).where(F.col("entity_type").isin(kinds))
    own = content_entities(entities, chunks, documents)
    fresh = _of(own, new).where(F.col("entity_type").isin(kinds)).select("chunk_id", "seq", "arrival", "entity_type", value)
    holders = every.select("entity_type", value, "arrival").distinct()
    if new is not None:
        holders = holders.join(fresh.select("entity_type", "value").distinct(), ["entity_type", "value"], "left_semi")
    common = holders_so_far(holders).where((F.col("arrival") > 4) & (F.col("df") > F.ceil(F.col("arrival") * DOC_FRACTION))).select("entity_type", "value", "arrival")
    fresh = fresh.join(common, ["entity_type", "value", "arrival"], "left_anti")
    hits = _shared(own, kinds, fresh)
    weight = F.create_map(*[F.lit(x) for pair in SHARED.items() for x in pair])
    reason = F.concat(F.lower("entity_type"), F.lit(":"), "value")
    return hits.select(*canonical(F.col("chunk_id"), F.col("other")), weight[F.col("entity_type")].alias("weight"), F.lit("shared_entity").alias("edge_type"), reason.alias("reason"))


def merge_edges(*families: DataFrame) -> DataFrame:
    """One edge for each pair: the largest weight, its first type and its last reason, in the order of the families.

    A later edge of equal weight replaces the reason but not the type, as repeated upserts would. Within a family,
    edges count once for each pair, the heaviest, then the smallest reason.
    """
    rows = reduce(DataFrame.unionByName, [f.select(*COLUMNS).withColumn("_seq", F.lit(k)) for k, f in enumerate(families)])
    # Dealt out once; what is sorted for the groups then stays where it is.
    pairs = rows.repartition("src_chunk", "dst_chunk").groupBy("src_chunk", "dst_chunk")
    first, last = F.min(F.struct(-F.col("weight"), "_seq", "reason", "edge_type")), F.min(F.struct(-F.col("weight"), -F.col("_seq"), "reason"))
    best = pairs.agg(F.max("weight").alias("weight"), first["edge_type"].alias("edge_type"), last["reason"].alias("reason"))
    return best.select(*COLUMNS)


def endpoints(edges: DataFrame) -> DataFrame:
    """(chunk_id, weight): a row for each end of each edge, so two for one that leads back to its own chunk."""
    return edges.select(F.col("src_chunk").alias("chunk_id"), "weight").unionAll(edges.select("dst_chunk", "weight"))


def strongest(edges: DataFrame, n: int, among: DataFrame | None = None) -> DataFrame:
    """(node, other, weight, edge_type, reason, rank): the n heaviest edges of each node, ties to the smaller other end. among (other): only these ends count."""
    place = F.row_number().over(W.partitionBy("node").orderBy(F.desc("weight"), "other"))
    both = symmetric(edges) if among is None else symmetric(edges).join(among, "other", "left_semi")
    return both.withColumn("rank", place).where(F.col("rank") <= n)


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: (node, other, weight, edge_type, reason)."""
    a = edges.select(F.col("src_chunk").alias("node"), F.col("dst_chunk").alias("other"), "weight", "edge_type", "reason")
    b = edges.select(F.col("dst_chunk").alias("node"), F.col("src_chunk").alias("other"), "weight", "edge_type", "reason")
    return a.unionByName(b.where("node <> other"))
