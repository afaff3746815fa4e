"""The inverted index and BM25."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import MOST_CHARS, index_terms, is_ascii, sanitize_query

K1, B = 1.2, 0.75
#: Chunks whose rows are laid out at once.
SLICE = 1024


def _count_ascii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = re.compile("[a-z0-9]+").findall
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            terms, counts, lengths, widths = [], [], [], []
            for text in part.column("content").to_pylist():
                own = [t for t in runs(text.lower()) if len(t) <= MOST_CHARS]
                tf = Counter(own)
                terms += tf.keys()
                counts += tf.values()
                lengths.append(len(own))
                widths.append(len(tf))
            if terms:
                chunk, doc = (part.column(c).take(pa.array(np.repeat(np.arange(len(widths)), widths))) for c in ("chunk_id", "doc_id"))
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), chunk, doc, pa.array(counts, pa.int32()), pa.array(np.repeat(lengths, widths), pa.int32())], ["term", "chunk_id", "doc_id", "tf", "dl"])


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, doc_id, tf, dl). A chunk's terms are counted inside its row: nothing is exchanged.

    ASCII contents, the bulk, are counted in an Arrow call, others by expressions that know all letters.
    """
    own = chunks.select("chunk_id", "doc_id", "content")
    plain = own.where(is_ascii(F.col("content"))).mapInArrow(_count_ascii, "term string, chunk_id string, doc_id string, tf int, dl int")
    terms = own.where(~is_ascii(F.col("content"))).select("chunk_id", "doc_id", index_terms(F.col("content")).alias("terms"))
    counted = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("tf")))
    return plain.unionByName(terms.select("chunk_id", "doc_id", F.size("terms").alias("dl"), F.inline(counted)).select("term", "chunk_id", "doc_id", "tf", "dl"))


def term_stats(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length. To be stored with the index: it reads all texts."""
    return chunks.agg(F.count("*").alias("n"), F.avg(F.size(index_terms(F.col("content")))).alias("avgdl"))


def stats_of_postings(posts: DataFrame, chunks: DataFrame) -> DataFrame:
    """corpus_stats of chunks without reading texts: a chunk's postings say how long it is. Chunks without a term count as empty."""
    lengths = posts.groupBy("chunk_id").agg(F.first("dl").alias("dl"))
    return chunks.select("chunk_id").join(lengths, "chunk_id", "left").agg(F.count("*").alias("n"), F.avg(F.coalesce("dl", F.lit(0))).alias("avgdl"))


def bm25_term(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def bm25(queries: DataFrame, posts: DataFrame, stats: DataFrame, k: int, visible: DataFrame | None = None, hidden: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best chunks for any of the query's terms, ties to the smaller chunk_id.

    posts may hold hidden chunks, if the visible ones (chunk_id) or the hidden documents (doc_id) are named: visible
    chunks alone count, for frequencies and for places, as in stats, the row of corpus_stats. The queries' terms travel
    to the postings, once to count and once to score: postings of a frequent term stay where they are, and what is
    exchanged are sums of a query and chunk. Nothing here grows with the corpus but these and the reading of postings.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(index_terms(sanitize_query(F.col("text"))))).alias("term"))

    def seen(rows: DataFrame) -> DataFrame:
        rows = rows if hidden is None else rows.join(hidden.select("doc_id"), "doc_id", "left_anti")
        return rows if visible is None else rows.join(visible.select("chunk_id"), "chunk_id", "left_semi")

    counts = term_stats(seen(posts.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")))
    hits = seen(posts.join(F.broadcast(wanted.join(F.broadcast(counts), "term")), "term")).crossJoin(F.broadcast(stats.select("n", "avgdl")))  # one row
    return best(hits.groupBy("query_id", "chunk_id").agg(F.sum(bm25_term(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"))).alias("score")), k)


def best(scored: DataFrame, k: int) -> DataFrame:
    """scored (query_id, chunk_id, score) with rank: the k best of each query, ties to the smaller chunk_id.

    The rounded score is a column: as an expression of the order it would be worked out in every comparison.
    """
    order = W.partitionBy("query_id").orderBy(F.desc("_near"), "chunk_id")
    return scored.withColumn("_near", F.round("score", 9)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_near")
