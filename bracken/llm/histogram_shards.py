"""Sharding by histogram sort.

Rows are ordered by a 128-bit key: the hash of the text, then the hash of the id, so equal texts lie side
by side and a group of copies that is larger than a shard is still cut where needed. Splitters are found
by counting, in each round, the exact bytes below candidate boundaries (the edges of the key's next
binary digits) and opening only the bins that still hold a wanted boundary; then the rows are exchanged
once, to the sub-range of the shard they belong to.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import inline_rows, let, staged

HALF = 1 << 63
#: Key bits of the lookup that finds the few splitters near a row.
TOP_BITS = 12
#: Counted boundaries of one round, at most; what the driver holds is bounded by it.
ROUND_BINS = 1 << 16


def _prefix(bits: int) -> tuple[Column, Column]:
    """The first `bits` bits of the key as two signed numbers that keep its order."""
    if bits <= 64:
        return F.shiftright("h", 64 - bits) if bits < 64 else F.col("h"), F.lit(0).cast("long")
    return F.col("h"), F.shiftright("d", 128 - bits) if bits < 128 else F.col("d")


def _unsigned(p: int, q: int, bits: int) -> int:
    """The prefix as an unsigned number of `bits` bits."""
    if bits <= 64:
        return p + (1 << (bits - 1))
    return ((p + HALF) << (bits - 64)) | (q + (1 << (bits - 65)))


def _signed(edge: int) -> tuple[int, int]:
    edge = min(edge, (1 << 128) - 1)
    return (edge >> 64) - HALF, (edge & ((1 << 64) - 1)) - HALF


def find_splitters(sizes: DataFrame, shards: int, parts: int, tolerance: float) -> list[tuple[int, int]]:
    """shards * parts - 1 boundaries (h, d) of the key in `sizes` (h, d, size).

    Boundaries of shards are within `tolerance` of a shard's bytes, those inside a shard within half a
    part. A bin of a single key can't be cut. The driver sees at most about ROUND_BINS counts a round.
    """
    spark, n = sizes.sparkSession, shards * parts
    bits, opened, found, total = 0, {None: (0, list(range(1, n)))}, {}, 0
    while opened:
        width = max(1, min(16, int(log2(ROUND_BINS / len(opened)))))
        width = min(width, (64 if bits < 64 else 128) - bits)
        rows = sizes
        if bits:
            p, q = _prefix(bits)
            wanted = inline_rows(spark, [{"p0": a, "q0": b} for a, b in opened], "p0 bigint, q0 bigint")
            rows = rows.withColumns({"p0": p, "q0": q}).join(F.broadcast(wanted), ["p0", "q0"], "left_semi")
        was, bits = bits, bits + width
        p, q = _prefix(bits)
        counted = rows.groupBy(p.alias("p"), q.alias("q")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
        bins: dict = {}
        for r in sorted(counted, key=lambda r: (r.p, r.q)):
            low = _unsigned(r.p, r.q, bits)
            bins.setdefault(low >> width if was else 0, []).append((low, r.p, r.q, r.b, r.n))
        if not was:
            total = sum(x[3] for x in bins.get(0, []))
            if not total:
                return []
        later: dict = {}
        for key, (below, targets) in opened.items():
            own = iter(bins[_unsigned(*key, was) if was else 0])
            low, p0, q0, size, count = next(own)
            for k in targets:
                at = total * k / n
                while below + size < at:
                    below += size
                    low, p0, q0, size, count = next(own)
                slack = tolerance * total / shards if k % parts == 0 else 0.5 * total / n
                if min(at - below, below + size - at) <= slack or count == 1 or bits == 128:
                    found[k] = (low + (at - below > below + size - at)) << (128 - bits)
                else:
                    later.setdefault((p0, q0), (below, []))[1].append(k)
        opened = later
    return [_signed(found[k]) for k in sorted(found)]


def _number_array(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _place(splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below the key (h, d): a lookup by the key's top bits, then the few there."""
    if not splitters:
        return F.lit(0).cast("long")
    top = [(h >> (64 - TOP_BITS)) + (1 << (TOP_BITS - 1)) for h, _ in splitters]
    starts, k = [], 0
    for b in range((1 << TOP_BITS) + 1):
        while k < len(top) and top[k] < b:
            k += 1
        starts.append(k)
    first, hs, ds = _number_array(starts), _number_array([h for h, _ in splitters]), _number_array([d for _, d in splitters])

    def search(row: Column) -> Column:
        h, d = row["h"], row["d"]
        b = (F.shiftright(h, 64 - TOP_BITS) + (1 << (TOP_BITS - 1))).cast("int")
        at, end = first[b], first[b + 1]
        inside = F.filter(F.sequence(at, end - 1), lambda i: (hs[i.cast("int")] < h) | ((hs[i.cast("int")] == h) & (ds[i.cast("int")] <= d)))
        return F.when(at == end, at).otherwise(at + F.size(inside))

    return let(F.struct(F.col("h"), F.col("d")), search)


def histogram_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), tolerance: float = 0.0005, part_bytes: int = 128 << 20) -> DataFrame:
    """Every row's shard, and its place there: (id, *carry, size, text_crc32, shard, slot).

    size is the text's UTF-8 bytes plus 8; a null text counts as no bytes, with the checksum of no bytes. An
    empty table gives no rows. Rows that agree in id and text are interchangeable and stay together. Only the
    named columns are read, so others, whatever their names, don't matter; `carry` moves more of them along.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8
    h, d = F.xxhash64(F.col(text_col)), F.xxhash64(F.lit("id"), F.col(id_col))
    sizes = staged(docs.select(h.alias("h"), d.alias("d"), size.alias("size")), "shards")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    parts = max(8, min(ceil(total / shards / part_bytes), ROUND_BINS // 4 // shards))
    place = _place(find_splitters(sizes, shards, parts, tolerance))
    counts = {r.part: r.n for r in sizes.select(place.alias("part")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    before = []
    for k in range(shards * parts):
        before.append(0 if k % parts == 0 else before[-1] + counts.get(k - 1, 0))
    rows = docs.select(F.col(id_col).alias("doc_id"), *carry, size.alias("size"), F.crc32(text).alias("text_crc32"), h.alias("h"), d.alias("d"))
    rows = rows.withColumn("part", place)
    rank = F.row_number().over(W.partitionBy("part").orderBy("h", "d", "doc_id")) - 1
    return rows.select(
        F.col("doc_id").alias(id_col), *carry, "size", "text_crc32",
        F.floor(F.col("part") / parts).cast("int").alias("shard"),
        (rank + _number_array(before)[F.col("part").cast("int")]).alias("slot"),
    )
