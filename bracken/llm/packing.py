"""Best-fit packing with Martello-Toth dominance reduction.

Documents become token pieces. What matters of a piece is its length, so the packing works on the counts of the at
most 4096 lengths, a table of fixed size, however large the corpus is: first it fixes sets of lengths that provably
can be in an optimal packing, then it packs what is left best-fit, longest first. Its result are bin patterns with
their numbers; pieces are dealt to them by rank within their length, in Spark.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, inline_rows, small_batches, staged, tidy

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: Words whose ids a worker keeps.
CACHED = 200_000
#: Pieces of a length that one task ranks.
RANK_ROWS = 1000


#: Texts of these characters only are cut here: ASCII without the separators 28 to 31, and letters that no normal form changes.
_PLAIN = re.compile("[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]*")
#: The tokenizer's own first cut, for such characters in lower case.
_FIRST_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x09-\x0d\x20a-zß-öø-ÿ0-9]+")


class Encoder:
    """Ids of whole texts as little-endian bytes.

    The tokenizer first cuts a text to words, and the ids of a word don't depend on the others. So words are looked
    up, and only new ones are encoded, many at a time: the last id of a word carries the end mark, which tells them
    apart. Texts with other characters, or with what may be a special token, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        suffix = self.tokenizer.model.end_of_word_suffix
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[k for token, k in vocab.items() if token.endswith(suffix)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            ids = self._ids(" ".join(some))
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(some):
                data, start = ids.tobytes(), 0
                for word, end in zip(some, (4 * at).tolist()):
                    self.known[word] = data[start:end]
                    start = end
            else:
                for word in some:
                    self.known[word] = self._ids(word).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [_PLAIN.fullmatch(x) is not None and "<|" not in x for x in texts]
        words = [_FIRST_CUT.findall(x.lower()) if ok else [] for x, ok in zip(texts, plain)]
        every = set().union(*words)
        new = list(every.difference(self.known))
        if len(self.known) + len(new) > CACHED:
            self.known.clear()
            new = list(every)
        self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, w)) if ok else self._ids(x).tobytes() for x, w, ok in zip(texts, words, plain)]


@cache
def encoder(path: str) -> Encoder:
    """A worker's own, kept from task to task."""
    return Encoder(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row: its ids, then END_ID, cut after each `capacity` ids.

    A null text is empty. path: the tokenizer's file on the executors. ids: with the ids themselves, as bytes.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_encoder, end = encoder(path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                rows: list[tuple] = []
                keys, texts = part.column("id").to_pylist(), [x or "" for x in part.column("text").to_pylist()]
                for key, data in zip(keys, own_encoder.encode(texts)):
                    data += end
                    for p, at in enumerate(range(0, len(data), 4 * capacity)):
                        own = data[at : at + 4 * capacity]
                        rows.append((key, p, at // 4, len(own) // 4, zlib.crc32(own), *([own] if ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), fields)], schema=fields)
        give_back()

    small_batches(docs.sparkSession)
    fields = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if ids else [])])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[list[int], int]], dict[int, int]]:
    """Martello-Toth reduction on counts by length: ([(lengths of a bin, how many such bins)], counts that are left).

    For a longest item j, with k* the longest other item that fits beside it, these sets dominate every other bin
    that could hold j, so some optimal packing has them:
    {j} if nothing fits; {j, k*} if it fills the bin, or if no two others fit together, or if no three do and k* is at
    least as long as the best pair that fits (each of the pair can take k*'s place elsewhere).
    """
    left = {x: n for x, n in counts.items() if n > 0}
    fixed: list[tuple[list[int], int]] = []
    for j in sorted(left, reverse=True):
        while left.get(j):
            room = capacity - j
            lengths = sorted(left)

            def others(x: int) -> int:
                return left[x] - (x == j)

            small: list[int] = []
            for x in lengths:
                small += [x] * min(3 - len(small), others(x))
                if len(small) == 3:
                    break
            if not small or small[0] > room:
                fixed.append(([j], left.pop(j)))
                break
            at = bisect_left(lengths, room + 1) - 1
            while at >= 0 and not others(lengths[at]):
                at -= 1
            k = lengths[at]
            two_fit = len(small) > 1 and small[0] + small[1] <= room
            three_fit = len(small) > 2 and sum(small) <= room
            if not (k == room or not two_fit or not three_fit and k >= _best_pair(lengths, others, room)):
                break
            n = left[j] // 2 if j == k else min(left[j], left[k])
            fixed.append(([j, k], n))
            for x in (j, k):
                left[x] -= n
            for x in {j, k}:
                if not left[x]:
                    del left[x]
    return fixed, left


def _best_pair(lengths: list[int], others, room: int) -> int:
    """The largest sum within room of two items."""
    best, a, b = 0, 0, len(lengths) - 1
    while a <= b:
        s = lengths[a] + lengths[b]
        if s > room or a == b and others(lengths[a]) < 2 or not others(lengths[b]):
            b -= 1
        else:
            if others(lengths[a]):
                best = max(best, s)
            a += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best-fit decreasing on counts by length; equal bins are handled together."""
    rooms: list[int] = []  # sorted, those with an open group
    groups: dict[int, list[tuple[list[int], int]]] = {}

    def put(room: int, items: list[int], n: int) -> None:
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((items, n))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            at = bisect_left(rooms, x)
            if at == len(rooms):
                per = capacity // x
                if n >= per:
                    put(capacity - per * x, [x] * per, n // per)
                if n % per:
                    put(capacity - n % per * x, [x] * (n % per), 1)
                break
            room = rooms[at]
            items, m = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            per = min(room // x, n)
            use = min(m, n // per)
            if m > use:
                put(room, items, m - use)
            put(room - per * x, items + [x] * per, use)
            n -= use * per
    return [g for own in groups.values() for g in own]


def plan_bins(counts: dict[int, int], capacity: int) -> list[dict]:
    """Runs of equal slots: the pieces of rank `low` to `high` (exclusive) of a length go, one each, to the bins from `bin` on, at `at`."""
    fixed, left = reduce_instance(counts, capacity)
    taken: dict[int, int] = {}
    rows, first = [], 0
    for items, n in fixed + best_fit(left, capacity):
        at = 0
        for x in items:
            low = taken.get(x, 0)
            rows.append({"l": x, "low": low, "high": low + n, "bin": first, "at": at})
            taken[x] = low + n
            at += x
        first += n
    return rows


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset.

    A piece of full length is a sequence by itself and needs no rank. The others are ranked within their length: those
    of a length are dealt by hash to as many buckets as give each about RANK_ROWS, and a rank is the count of the
    buckets before plus the rank inside, so that a length with a third of all rows fills many tasks. Rows without an
    id, and rows that repeat, are pieces like others; of equal rows any may take the earlier place. An empty table
    gives no rows.
    """
    pieces = staged(pieces, "pieces")
    tidy(pieces.sparkSession)
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    bins = plan_bins({x: n for x, n in counts.items() if x < capacity}, capacity)
    columns = pieces.columns
    # Numbers of full sequences go on behind the others; they have gaps between partitions.
    behind = max((r["bin"] + r["high"] - r["low"] for r in bins), default=0)
    full = pieces.where(F.col("length") == capacity).select(*columns, (behind + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if not bins:
        return full
    buckets = F.element_at(F.split(F.lit(",".join(str(-(-counts.get(x, 0) // RANK_ROWS) or 1) for x in range(capacity))), ",").cast("array<int>"), (F.col("length") + 1).cast("int"))
    short = pieces.where(F.col("length") < capacity).withColumn("_bucket", F.pmod(F.xxhash64(*columns), buckets))
    per = short.groupBy("length", "_bucket").agg(F.count("*").alias("n"))
    base = per.select("length", "_bucket", (F.sum("n").over(W.partitionBy("length").orderBy("_bucket")) - F.col("n")).alias("_base"))
    rank = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = short.withColumn("_rank", rank).join(base, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    # A length's runs stand in one array, so that a row meets only those of its own length; the last that begins at or before its rank holds it.
    plan = inline_rows(pieces.sparkSession, bins, "l bigint, low bigint, high bigint, bin bigint, at bigint")
    runs = plan.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("low", "bin", "at"))).alias("_runs"))
    out = ranked.join(F.broadcast(runs), F.col("length") == F.col("l"))  # a few runs for each of fewer than `capacity` lengths
    out = out.withColumn("_run", F.element_at(F.filter("_runs", lambda r: r["low"] <= F.col("_rank")), -1))
    return full.unionByName(out.select(*columns, (F.col("_run.bin") + F.col("_rank") - F.col("_run.low")).alias("sequence_id"), F.col("_run.at").alias("offset")))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences' ids, from packed pieces that carry them: (sequence_id, ids)."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(inside.alias("own")).select("sequence_id", F.aggregate("own", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
