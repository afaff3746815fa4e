"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by pseudo-rotations (three rounds of random signs and a Hadamard transform) and falls to the
nearest signed axis. Each table has its own rotations; queries also probe the next nearest axes. Vectors that share
a bucket with a query are scored there: roughly by one product of matrices, and those that may be among the best
exactly, in double precision; only a bucket's best leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, scan_groups, staged

#: Vectors, and queries, of a bucket that one task scores; larger buckets are split by id on both sides.
BUCKET_ROWS, BUCKET_QUERIES = 8192, 4096
#: Queries that are compared with a bucket's vectors in one product.
QUERY_ROWS = 256
#: Rough cosines are right to this; what lies so near to the k-th is scored exactly.
SLACK = 1e-5


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised Walsh-Hadamard transform of each row; the width is a power of two.

    Six butterfly stages are done at once, as a product with the transform of 64 numbers.
    """
    n, d = x.shape
    h = 1
    while h < d:
        f = min(64, d // h)
        small = np.ones((1, 1), x.dtype)
        while len(small) < f:
            small = np.block([[small, small], [small, -small]])
        y = x.reshape(n, d // (f * h), f, h)
        x = (y[..., 0] @ small if h == 1 else small @ y).reshape(n, d)
        h *= f
    return x


class Tables:
    """A rotation of `dim` for each table; a bucket is a signed axis, written as one number.

    The number of buckets does not depend on the number of vectors: with more buckets and as many probes, neighbours
    would be lost.
    """

    def __init__(self, dim: int, tables: int, seed: int = 11):
        self.dim, self.tables = dim, tables
        self.width = 1 << max(1, (dim - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), (tables, 3, self.width))

    def turned(self, x: np.ndarray, table: int) -> np.ndarray:
        y = np.zeros((len(x), self.width), np.float32)
        y[:, : self.dim] = x
        for signs in self.signs[table]:
            y = hadamard(y * signs) / np.float32(self.width**0.5)
        return y

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        y = self.turned(x, table)
        axis = np.abs(y).argmax(axis=1)
        return 2 * axis + (y[np.arange(len(x)), axis] < 0)

    def probes(self, x: np.ndarray, table: int, probes: int) -> np.ndarray:
        """(rows, probes): the buckets whose axes are nearest, the own one first."""
        y = self.turned(x, table)
        near = np.argsort(-np.concatenate((y, -y), axis=1), axis=1, kind="stable")[:, :probes]
        return 2 * (near % self.width) + near // self.width


def _matrix(vectors: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of `dim` numbers each, none null."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, which is exact, so that squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    y = _scaled(x)
    return (y / np.sqrt((y * y).sum(axis=1, keepdims=True))).astype(np.float32)


def best_in_bucket(queries: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (query number, id, cosine): for each query the k nearest rows, ties to the smaller id. Equal rows get equal numbers."""
    queries, data = _scaled(queries), _scaled(data)
    length = np.sqrt((data * data).sum(axis=1))
    unit = (data / length[:, None]).astype(np.float32).T
    for at in range(0, len(queries), QUERY_ROWS):
        own = queries[at : at + QUERY_ROWS]
        norm = np.sqrt((own * own).sum(axis=1))
        if len(data) > 4 * k:
            rough = (own / norm[:, None]).astype(np.float32) @ unit
            q, x = np.nonzero(rough >= np.partition(rough, len(data) - k, axis=1)[:, len(data) - k, None] - SLACK)
        else:
            q, x = (i.ravel() for i in np.indices((len(own), len(data))))
        for part in np.array_split(np.arange(len(own)), max(1, -(-len(q) // 200_000))):
            # As a rule one part; more only where very many rows are equally near.
            a, b = np.searchsorted(q, [part[0], part[-1] + 1])
            qi, xi = q[a:b], x[a:b]
            score = (data[xi] * own[qi]).sum(axis=1) / (norm[qi] * length[xi])
            order = np.lexsort((ids[xi], -score, qi))
            qi, xi, score = qi[order], xi[order], score[order]
            stay = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
            yield at + qi[stay], ids[xi[stay]], score[stay]


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = 8, probes: int = 12, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, <id>, score): the k nearest rows found for each row for which is_query holds, itself excluded.

    Nearness is the cosine in double precision, ties go to the smaller id. Rows whose vector is null, of zeros, or
    holds a null or non-finite number take no part; neither do those without an id or of another length than the most
    frequent one. Equal vectors are searched once, with their k + 1 smallest ids: no more of them can be among any
    row's k nearest. A query for which fewer than k rows were found is compared with all rows, so that tables of any
    size give k rows, or all candidates if fewer. Ids that repeat count once for equal vectors. An empty table gives
    no rows; columns but id, vector and those of is_query aren't read.

    Vectors are hashed once. A bucket of n rows and m queries is dealt to ceil(n / BUCKET_ROWS) * ceil(m /
    BUCKET_QUERIES) groups, so that a tight cluster, which puts all its rows and queries into few buckets, fills many
    tasks and none beyond a bounded size.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    spark = vectors.sparkSession
    if most is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    dim, hashing = most.d, Tables(most.d, tables)
    rows = rows.where(F.size("v") == dim)
    kind = vectors.schema[vector_col].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bucket in each table; of queries also the probed buckets, a table's after another's."""
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column("v"), dim))
            own = np.stack([hashing.buckets(unit, t) for t in range(tables)], axis=1)
            asks = batch.column("q").to_numpy(zero_copy_only=False).astype(bool)
            near = np.stack([hashing.probes(unit[asks], t, probes) for t in range(tables)], axis=1)
            told = iter(near.reshape(len(near), tables * near.shape[2]))
            columns = [pa.array(list(own), pa.list_(pa.int64())), pa.array([next(told) if a else None for a in asks], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("cid", "ids", "q", "v")] + columns, names=["cid", "ids", "q", "v", "own", "near"])
        give_back()

    # Equal vectors: one class, with the k + 1 smallest ids.
    place = F.dense_rank().over(W.partitionBy("v").orderBy("id"))
    asked = rows.groupBy("v").agg(F.max("q").alias("q"))
    classes = rows.select("id", "v").withColumn("r", place).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    classes = classes.join(asked, "v").select(F.col("ids")[0].alias("cid"), "ids", "q", "v")
    classes = staged(classes.mapInArrow(hashed, f"cid long, ids array<long>, q boolean, v {kind}, own array<long>, near array<long>"), "ann-classes")
    queries = rows.where("q").select("id", "v").distinct()
    per_table = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.struct(t.alias("t"), F.slice("near", t * min(probes, 2 * hashing.width) + 1, F.lit(min(probes, 2 * hashing.width))).alias("b")))
    indexed = classes.select("cid", "v", F.posexplode("own").alias("t", "b"))
    probed = classes.where("q").select("cid", "v", F.explode(per_table).alias("x")).select("cid", "v", "x.t", F.explode("x.b").alias("b"))

    def score(group: pa.Table) -> Iterator[pa.RecordBatch]:
        asking = group.column("asks").to_numpy()
        cid, v = group.column("cid").to_numpy(), _matrix(group.column("v"), dim)
        if asking.any() and not asking.all():
            of = cid[asking]
            for q, near, value in best_in_bucket(v[asking], v[~asking], cid[~asking], k + 1):
                yield pa.RecordBatch.from_arrays([pa.array(of[q]), pa.array(near), pa.array(value)], names=["qcid", "cid", "score"])

    def scored(data: DataFrame, asks: DataFrame) -> DataFrame:
        """The best of each bucket. Its parts are known from counts: a row for each bucket, of which there are tables * 2 * width."""
        n = data.groupBy("t", "b").agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("n"))
        m = asks.groupBy("t", "b").agg(F.ceil(F.count("*") / BUCKET_QUERIES).alias("m"))
        parts = F.broadcast(staged(n.join(m, ["t", "b"]), "ann-parts"))
        spread = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
        salt = lambda c: F.pmod(F.xxhash64("cid"), F.col(c))
        left = data.join(parts, ["t", "b"]).withColumn("p", salt("n")).withColumn("s", spread("m"))
        right = asks.join(parts, ["t", "b"]).withColumn("s", salt("m")).withColumn("p", spread("n"))
        columns = [F.col("t").cast("long").alias("t"), "b", "p", "s"]
        both = left.select(*columns, F.lit(False).alias("asks"), "cid", "v").unionByName(right.select(*columns, F.lit(True).alias("asks"), "cid", "v"))
        found = scan_groups(both, ["t", "b", "p", "s"], score, "qcid long, cid long, score double")
        own = found.repartition("qcid").groupBy("qcid", "cid").agg(F.max("score").alias("score"))
        order = W.partitionBy("qcid").orderBy(F.desc("score"), "cid")
        return own.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)

    found = staged(scored(indexed, probed), "ann-found")
    # Each class stands for up to k + 1 ids, so fewer than k + 1 other rows are possible only where few ids were met.
    met = found.join(classes.select("cid", F.size("ids").alias("n")), "cid").groupBy("qcid").agg(F.sum("n").alias("n"))
    short = staged(classes.where("q").select("cid", "v").join(met.where(F.col("n") > k), F.col("cid") == F.col("qcid"), "left_anti"), "ann-short")
    if not short.isEmpty():
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2 * hashing.width - 1).cast("long")))
        found = found.unionByName(scored(indexed.where("t = 0"), short.select("cid", "v", F.lit(0).alias("t"), every.alias("b"))))
    results = found.join(classes.select("cid", "ids"), "cid").select("qcid", F.explode("ids").alias("other"), "score")
    order = W.partitionBy("qcid").orderBy(F.desc("score"), "other")
    results = results.distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    members = queries.join(classes.select("v", F.col("cid").alias("qcid")), "v").select(F.col("id").alias("query_id"), "qcid")
    out = members.join(results, "qcid").where("query_id <> other").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "other")))
    return out.where(F.col("rank") <= k).select("query_id", "rank", F.col("other").alias(id_col), "score")
