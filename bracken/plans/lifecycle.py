"""Changes to tables as DataFrames: upserts, deletes, invalidation, statistics. How they reach the disk: workspace.py."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.edges import COLUMNS

#: n_chunks and n_terms: chunks of a document and the words in them, of which search's counts are sums.
SCHEMAS = {
    "documents": "doc_id string, path string, filename string, format string, size_bytes long, hash string, indexed_at timestamp, status string, error_msg string, doc_class string, n_chunks long, n_terms long",
    "chunks": "doc_id string, page int, chunk_index int, char_start int, char_end int, content string, chunk_id string, chunk_signal string",
    "vectors": "chunk_id string, doc_id string, embedding array<double>",
    "edges": "src_chunk string, dst_chunk string, weight double, edge_type string, reason string",
    "entities": "chunk_id string, doc_id string, seq int, entity_type string, value string, confidence double, normalized_value string",
    "postings": "term string, chunk_id string, doc_id string, tf int, dl int",
    "settings": "key string, value string",
}


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """new, and of old what new has no key of."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """By path: a known path keeps its doc_id."""
    known = old.select("path", F.col("doc_id").alias("_old"))
    own = new.join(known, "path", "left").withColumn("doc_id", F.coalesce("_old", "doc_id")).drop("_old")
    return upsert(old, own, "path")


def without_docs(tables: dict[str, DataFrame], doc_ids: DataFrame, keep_documents: bool = False) -> dict[str, DataFrame]:
    """All tables without these documents: their chunks, vectors, entities, postings and edges go with them."""
    out = dict(tables)
    gone = tables["chunks"].join(doc_ids, "doc_id", "left_semi").select("chunk_id")
    if not keep_documents:
        out["documents"] = tables["documents"].join(doc_ids, "doc_id", "left_anti")
    out["chunks"] = tables["chunks"].join(doc_ids, "doc_id", "left_anti")
    for name in ("vectors", "entities", "postings"):
        if name in tables:
            out[name] = tables[name].join(gone, "chunk_id", "left_anti").select(*tables[name].columns)
    if "edges" in tables:
        for end in ("src_chunk", "dst_chunk"):
            out["edges"] = out["edges"].join(gone.withColumnRenamed("chunk_id", end), end, "left_anti").select(*tables["edges"].columns)
    return out


def upsert_edges(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """old after the edges of new in `order`: the largest weight, its first type, and its last reason."""
    rows = old.select(*COLUMNS).withColumn("_seq", F.lit(-1).cast("long")).unionByName(new.select(*COLUMNS, F.col(order).cast("long").alias("_seq")))
    best = rows.groupBy("src_chunk", "dst_chunk").agg(F.max("weight").alias("weight"), F.max_by("edge_type", F.struct("weight", -F.col("_seq"))).alias("edge_type"), F.max_by("reason", F.struct("weight", "_seq")).alias("reason"))
    return best.select(*COLUMNS)


def mark_status(documents: DataFrame, doc_ids: DataFrame, status: str, error: str | None = None) -> DataFrame:
    own = documents.join(doc_ids.select("doc_id").distinct().withColumn("_hit", F.lit(True)), "doc_id", "left")
    return own.withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).withColumn("error_msg", F.when(F.col("_hit"), F.lit(error)).otherwise(F.col("error_msg"))).drop("_hit").select(*documents.columns)


def changed_files(files: DataFrame, documents: DataFrame) -> DataFrame:
    """Files that aren't indexed with the same hash; they are found before anything is parsed."""
    done = documents.where("status = 'indexed'").select("path", "hash")
    return files.join(done, ["path", "hash"], "left_anti")


def invalidate(tables: dict[str, DataFrame], versions: dict[str, str]) -> dict[str, DataFrame]:
    """If a model's version isn't the stored one: derived tables are emptied, documents wait without a hash."""
    stored = {r.key: r.value for r in tables["settings"].collect()}  # a few settings
    if all(stored.get(k) == v for k, v in versions.items()):
        return tables
    spark = tables["documents"].sparkSession
    out = {n: spark.createDataFrame([], SCHEMAS[n]) if n not in ("documents", "settings") else t for n, t in tables.items()}
    out["documents"] = tables["documents"].withColumn("status", F.lit("pending")).withColumn("hash", F.lit(""))
    out["settings"] = upsert(tables["settings"], spark.createDataFrame(list(versions.items()), SCHEMAS["settings"]), "key")
    return out


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, value): rows by table, edges by type, and the last time of indexing."""
    counts = [t.agg(F.count("*").cast("string").alias("value")).select(F.lit(n).alias("name"), "value") for n, t in tables.items()]
    kinds = tables["edges"].groupBy("edge_type").agg(F.count("*").cast("string").alias("value")).select(F.concat(F.lit("edges:"), "edge_type").alias("name"), "value")
    last = tables["documents"].agg(F.max("indexed_at").cast("string").alias("value")).select(F.lit("last_indexed").alias("name"), "value")
    out = kinds.unionByName(last)
    for c in counts:
        out = out.unionByName(c)
    return out


def workdir_id(path: str) -> str:
    return hashlib.sha256(path.encode()).hexdigest()[:16]


def workdirs(paths: DataFrame) -> DataFrame:
    """paths (workdir, ...) with the id that names a workdir's folder."""
    return paths.withColumn("workdir_id", F.substring(F.sha2("workdir", 256), 1, 16))


def recent_first(uses: DataFrame, key: str, when: str, limit: int) -> DataFrame:
    """(key, last_used): those used last come first."""
    return uses.groupBy(key).agg(F.max(when).alias("last_used")).orderBy(F.desc("last_used"), key).limit(limit)


def named_like(documents: DataFrame, part: str) -> DataFrame:
    """Documents whose filename holds `part`, whatever the case."""
    return documents.where(F.lower("filename").contains(part.lower()))


def at_path(documents: DataFrame, path: str) -> DataFrame:
    return documents.where(F.col("path") == path)


def chunks_of(chunks: DataFrame, doc_id: str) -> DataFrame:
    """A document's chunks, in their order."""
    return chunks.where(F.col("doc_id") == doc_id).orderBy("chunk_index")


def without_failed(files: DataFrame, failed: DataFrame, key: str = "path") -> DataFrame:
    return files.join(failed.select(key), key, "left_anti")
