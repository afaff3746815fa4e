"""Near-duplicate detection: MinHash bands, sequential Bayesian verification of signatures, exact verification.

Equal shingle sets become one node first. Nodes meet in band buckets. Two signatures are compared a batch of hashes
at a time; a pair is given up as soon as the posterior probability that it reaches the threshold is below the chosen
miss probability. Survivors are verified on their full shingle sets.

No bucket is expanded into its pairs. The components are what is wanted, so first each node has only its best
partner in another component verified, within a few of its buckets; what links is contracted. After some such
rounds, all buckets that still hold several components are searched in full: there a first scan marks the nodes that
have a surviving partner in another component, and a second one, to which only these bring their full sets, verifies
every surviving pair whose components nothing has linked yet. It gives one link for each two components that it joins.
So no link that the bands and the posterior bound let through can be missed, and pairs that are none leave no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, scan_groups, small_batches, staged, tidy
from .shingles import mix, shingle_set, word_hashes

U = np.uint64
#: Bands of so many rows: a pair at the threshold of 0.75 shares no band with probability (1 - 0.75^6)^64 = 4e-6.
BANDS, ROWS = 64, 6
#: Hashes that are compared before the posterior is looked at again.
BATCH = 32
#: Probability of giving up a pair that reaches the threshold.
MISS = 1e-5
#: Nodes of a bucket that one task compares; larger buckets are split in the first rounds.
BLOCK = 1024


@cache
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(17)
    n = BANDS * ROWS
    return r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of a set that isn't empty."""
    a, b = _hashes()
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    x = (shingles >> U(32)).astype(np.uint32)
    for k in range(0, len(x), 1024):
        np.minimum(out, (x[k : k + 1024] * a[:, None] + b[:, None]).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(U)
    h = np.arange(BANDS, dtype=U)
    for k in range(ROWS):
        h = mix(h * U(0x9E3779B97F4A7C15) + rows[:, k])
    return h.view(np.int64)


@cache
def least_matches(threshold: float, miss: float = MISS) -> tuple[int, ...]:
    """After each batch: the fewest equal bytes with which P(similarity >= threshold) is still `miss` / batches or more.

    So a pair of the threshold is given up with a probability of at most `miss` in all batches together.

    The prior is uniform. Bytes of different minima agree once in 256 times. With m of n equal, the posterior is a
    beta distribution, and its tail P(Binomial(n + 1, threshold) <= m).
    """
    p = threshold + (1 - threshold) / 256
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            if total >= miss / (BANDS * ROWS // BATCH):
                break
            m += 1
        out.append(m)
    return tuple(out)


def survivors(one: np.ndarray, many: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `many` that may reach the threshold with `one`, and their equal bytes."""
    at, equal = np.arange(len(many)), np.zeros(len(many), np.int32)
    for k, least in enumerate(least_matches(threshold)):
        own = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal + (many[at, own] == one[own]).sum(axis=1)
        stay = equal >= least
        at, equal = at[stay], equal[stay]
        if not len(at):
            break
    return at, equal


def _signed_rows(batch: pa.RecordBatch, width: int) -> Iterator[tuple]:
    ids, texts = batch.column("id"), batch.column("text").cast(pa.large_binary())
    for i in range(0, len(ids), 200):
        keys = ids.slice(i, 200).to_pylist()
        for key, words in zip(keys, word_hashes([x or b"" for x in texts.slice(i, 200).to_pylist()])):
            yield key, shingle_set(words, width)


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, th, n, cid, sig, bands) of each row; th: the text's hash; cid tells equal sets, and like sig and bands is null for empty ones."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("cid", pa.binary()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for th, (key, s) in zip(batch.column("th").to_pylist(), _signed_rows(batch, width)):
                if len(s):
                    sig = signature(s)
                    out.append((key, th, len(s), hashlib.blake2b(s, digest_size=16).digest(), sig.astype(np.uint8).tobytes(), band_keys(sig)))
                else:
                    out.append((key, th, 0, None, None, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        give_back()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).mapInArrow(sign, "doc_id long, th long, n long, cid binary, sig binary, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(nid, shingles) of the nodes (nid, cid, doc_id, th), made again from the texts.

    They are found by id and text, so that texts without an id, or with one that repeats, don't all meet.
    """
    schema = pa.schema([("cid", pa.binary()), ("shingles", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(hashlib.blake2b(s, digest_size=16).digest(), s.tobytes()) for _, s in _signed_rows(batch, width)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()) for c in zip(*own)], schema=schema)
        give_back()

    wanted = nodes.select(F.col("doc_id").alias("_want"), F.col("th").alias("_th")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    # By merge at every size: how many are wanted grows with the corpus.
    made = texts.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("_want")) & (F.col("th") == F.col("_th")), "left_semi").mapInArrow(make, "cid binary, shingles binary")
    found = nodes.select("nid", "cid").join(made, "cid")
    return found.groupBy("nid").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (x, y) that reach the threshold on their full sets."""
    percent = round(100 * threshold)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for a, b in zip(pdf["a"], pdf["b"]):
                a, b = np.frombuffer(a, U), np.frombuffer(b, U)
                both = np.concatenate((a, b))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok.append(100 * shared >= percent * (len(both) - shared))
            yield pdf.loc[np.array(ok, bool), ["x", "y"]]
        give_back()

    a, b = sets.select(F.col("nid").alias("x"), F.col("shingles").alias("a")), sets.select(F.col("nid").alias("y"), F.col("shingles").alias("b"))
    return pairs.join(a, "x").join(b, "y").select("x", "y", "a", "b").mapInPandas(compare, "x long, y long")


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label) for all nodes of the links (x, y): the smallest node reachable. labels: those known before.

    Each round, components hook to their smallest neighbour and paths are halved twice; every round is written, so
    a lost executor costs no more than a round.
    """
    nodes = links.select(F.col("x").alias("node")).union(links.select("y")).distinct()
    if labels is None:
        now = nodes.withColumn("label", F.col("node"))
    else:
        now = labels.unionByName(nodes.join(labels, "node", "left_anti").withColumn("label", F.col("node")))
    now = staged(now, "labels")
    while True:
        a = now.select(F.col("node").alias("x"), F.col("label").alias("la"))
        b = now.select(F.col("node").alias("y"), F.col("label").alias("lb"))
        apart = links.join(a, "x").join(b, "y").where("la <> lb")
        hooks = staged(apart.groupBy(F.greatest("la", "lb").alias("label")).agg(F.min(F.least("la", "lb")).alias("to")), "hooks")
        if hooks.isEmpty():
            return now
        for _ in range(2):
            further = hooks.select(F.col("label").alias("to"), F.col("to").alias("next"))
            hooks = hooks.join(further, "to", "left").select("label", F.coalesce("next", "to").alias("to"))
        now = staged(now.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, threshold: float = 0.75, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs.

    Rows are linked when the Jaccard similarity of their sets of `width`-word shingles (A-Z lower-cased, words between
    ASCII white space) is at least the threshold; a text of fewer words has one shingle, all of it. Null texts and
    those without words have none and are linked with nothing. component_id is the smallest doc_id of a row's
    component; rows without a doc_id don't name one, and are never kept: a component of such rows alone has none. kept:
    doc_id = component_id; rows that repeat an id are kept together. Only id and text are read, so columns named like
    results don't matter. An empty table gives no rows.
    """
    rows = staged(signatures(docs, width, id_col, text_col), "signatures")
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("place")
    one = rows.where("cid is not null").groupBy("cid").agg(place, F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    signed = staged(one.select("cid", "place.doc_id", "place.th", "sig", "bands").withColumn("nid", F.monotonically_increasing_id()), "nodes")
    nodes = signed.select("nid", "cid", "doc_id", "th")
    bands = signed.select("nid", F.posexplode("bands").alias("band", "key"))
    shared = bands.groupBy("key").agg(F.min("nid").alias("low"), F.max("nid").alias("high"), F.count("*").alias("n")).where("low < high")
    members = staged(bands.join(shared.select("key", "n"), "key"), "members")
    met = members.select("nid").distinct()
    # Two bytes of each band key stand behind the signature's bytes: they tell in which band two nodes meet first.
    tags = F.transform("bands", lambda k: F.substring(F.hex(k), -4, 4))
    tagged = F.concat("sig", F.unhex(F.array_join(F.transform(tags, lambda t: F.lpad(t, 4, "0")), "")))
    sigs = staged(signed.select("nid", tagged.alias("sig")).join(met, "nid", "left_semi"), "met")
    sets = staged(_sets(docs, nodes.join(met, "nid", "left_semi"), width, id_col, text_col), "sets")
    tidy(docs.sparkSession)
    labels = links = None
    #: Largest buckets of a node that a round looks at; None: all buckets, and all pairs between components.
    for few in (3, 6, None):
        own = members
        if labels is not None:
            own = own.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
            open_keys = own.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
            own = own.join(open_keys.select("key"), "key", "left_semi")
        else:
            own = own.withColumn("label", F.col("nid"))
        if few:
            place = F.row_number().over(W.partitionBy("nid").orderBy(F.desc("n"), F.xxhash64("key", F.lit(few))))
            own = own.withColumn("place", place).where(F.col("place") <= few)
            blocks = own.withColumn("low", F.pmod(F.xxhash64("nid"), F.ceil(F.col("n") / BLOCK))).withColumn("high", F.col("low")).withColumn("part", F.col("low"))
        else:
            # Of a large bucket each pair of blocks is a group.
            most = F.ceil(F.col("n") / BLOCK)
            blocks = own.withColumn("part", F.pmod(F.xxhash64("nid"), most)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), most - 1)))
            blocks = blocks.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
        groups = ["key", "low", "high"]
        rows_of = blocks.join(sigs, "nid").select(*groups, "part", "band", "nid", "label", "sig")
        if few:
            found = scan_groups(rows_of, groups, _best_partner(threshold), "x long, y long, m long")
            found = found.groupBy("x").agg(F.max_by("y", F.struct("m", -F.col("y"))).alias("y"))
            pairs = found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
            new = staged(_verified(pairs, sets, threshold), "links")
        else:
            marked = staged(scan_groups(rows_of, groups, _marker(threshold), "key long, low long, high long, part long, band int, nid long, label long"), "marked")
            told = marked.join(sigs, "nid").join(sets, "nid").select(*groups, "part", "band", "nid", "label", "sig", "shingles")
            new = staged(scan_groups(told, groups, _linker(threshold), "x long, y long").distinct(), "links")
        links = new if links is None else links.unionByName(new)
        labels = components(links, labels)
        tidy(docs.sparkSession)
    comp = nodes.join(labels.withColumnRenamed("node", "nid"), "nid", "left").withColumn("label", F.coalesce("label", "nid"))
    least = comp.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    comp = comp.select("cid", "label").join(least, "label").select("cid", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "cid").join(comp, "cid", "left")
    out = out.withColumn("component_id", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


class _Group:
    """The nodes of a bucket, or of a pair of its blocks."""

    def __init__(self, group: pa.Table):
        self.ids, self.label, self.part = (group.column(c).to_numpy() for c in ("nid", "label", "part"))
        self.band = group.column("band")[0].as_py()
        self.split = group.column("low")[0].as_py() != group.column("high")[0].as_py()
        self.apart = bool((self.label != self.label[0]).any())
        if self.apart:
            both = np.frombuffer(b"".join(group.column("sig").to_pylist()), np.uint8).reshape(len(self.ids), -1)
            self.sig = np.ascontiguousarray(both[:, : BANDS * ROWS])
            self.tags = np.ascontiguousarray(both[:, BANDS * ROWS :]).view(np.uint16)

    def partners(self, i: int, other: np.ndarray, threshold: float) -> np.ndarray:
        """Later nodes among `other` that survive with node i, and share no earlier band with it. Pairs inside a block belong to the block's own group."""
        other[: i + 1] = False
        if self.split:
            other &= self.part != self.part[i]
        at = np.flatnonzero(other)
        if not len(at):
            return at
        own = at[survivors(self.sig[i], self.sig[at], threshold)[0]]
        same = (self.sig[own].reshape(-1, BANDS, ROWS) == self.sig[i].reshape(BANDS, ROWS)).all(axis=2) & (self.tags[own] == self.tags[i])
        return own[same.argmax(axis=1) == self.band] if len(own) else own


def _best_partner(threshold: float):
    """(x, y, m): for each node the survivor of another component that agrees most."""
    schema = pa.schema([(c, pa.int64()) for c in "xym"])

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        g, rows = _Group(group), []
        for i in range(len(g.ids)) if g.apart else ():
            at = np.flatnonzero(g.label != g.label[i])
            own, equal = survivors(g.sig[i], g.sig[at], threshold)
            if len(own):
                best = np.lexsort((g.ids[at[own]], -equal))[0]
                rows.append((g.ids[i], g.ids[at[own[best]]], equal[best]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c), pa.int64()) for c in zip(*rows)], schema=schema)

    return run


def _marker(threshold: float):
    """The group's nodes that have a surviving partner in another component; at most the rows that came."""

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        g = _Group(group)
        if not g.apart:
            return
        mark = np.zeros(len(g.ids), bool)
        for i in range(len(g.ids)):
            own = g.partners(i, g.label != g.label[i], threshold)
            mark[own] = True
            mark[i] |= len(own) > 0
        if mark.any():
            yield from group.drop_columns(["sig"]).filter(pa.array(mark)).combine_chunks().to_batches()

    return run


def _linker(threshold: float):
    """(x, y): a verified link for each two components that the group joins, on full sets; components that it has joined are one."""
    percent = round(100 * threshold)

    def run(group: pa.Table) -> Iterator[pa.RecordBatch]:
        g = _Group(group)
        if not g.apart:
            return
        sets, label, rows = [np.frombuffer(x, U) for x in group.column("shingles").to_pylist()], g.label.copy(), []
        for i in range(len(g.ids)):
            own = g.partners(i, label != label[i], threshold)
            for at in range(0, len(own), 64):
                # Some at a time: the first link of a component spares its others.
                some = own[at : at + 64]
                some = some[label[some] != label[i]]
                if not len(some):
                    continue
                sizes = np.array([len(sets[j]) for j in some])
                every = np.concatenate([sets[j] for j in some])
                mine = np.sort(sets[i])
                hit = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
                shared = np.add.reduceat(hit.astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
                for j in some[100 * shared >= percent * (sizes + len(mine) - shared)]:
                    if label[j] != label[i]:
                        rows.append((g.ids[i], g.ids[j]))
                        label[label == label[j]] = label[i]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c), pa.int64()) for c in zip(*rows)], names=["x", "y"])

    return run
