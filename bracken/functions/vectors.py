"""Vector operators as Column expressions: cosine similarity and the deterministic hash embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 384
#: Fixed values of the token hash: its start, and a prime of 2^40 + 435.
HASH_START, HASH_LOW = 1469598103934665603, 435
_MASK = 0xFFFFFFFF


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """In [0, 1]; 0 for vectors of other lengths, of zeros, or pointing away from each other."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norm = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    value = _sum(F.zip_with(a, b, lambda x, y: x * y)) / norm
    return F.when((F.size(a) == F.size(b)) & (norm > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))).otherwise(F.lit(0.0))


def token_bucket(token: Column) -> Column:
    """64-bit multiplicative hash of the token's bytes, modulo DIM, on two halves of 32 bits."""
    hexed = F.hex(F.encode(token, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(0), F.octet_length(token) - 1), lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(HASH_START >> 32).cast("long").alias("hi"), F.lit(HASH_START & _MASK).cast("long").alias("lo"))

    def step(s: Column, b: Column) -> Column:
        x = s["lo"].bitwiseXOR(b)
        low = x * HASH_LOW
        high = s["hi"] * HASH_LOW + F.shiftright(low, 32) + F.shiftleft(x, 8)
        return F.struct(high.bitwiseAND(_MASK).alias("hi"), low.bitwiseAND(_MASK).alias("lo"))

    def end(s: Column) -> Column:
        return ((s["hi"] % DIM) * ((1 << 32) % DIM) + s["lo"]) % DIM

    return F.when(F.octet_length(token) > 0, F.aggregate(octets, start, step, end))


def hash_embedding(text: Column) -> Column:
    """Counts of the white-space tokens' buckets, as a unit vector of DIM; zeros for a text without tokens."""
    buckets = F.transform(F.filter(F.split(text, r"\s+"), lambda t: t != ""), token_bucket)
    counts = F.transform(F.array(buckets), lambda b: F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")))[0]

    def unit(v: Column) -> Column:
        norm = F.sqrt(_sum(F.transform(v, lambda x: x * x)))
        return F.transform(F.array(F.struct(v.alias("v"), norm.alias("n"))), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x / s["n"]).otherwise(x)))[0]

    return F.transform(F.array(counts), unit)[0]


@lru_cache(maxsize=200_000)
def _bucket(token: str) -> int:
    h = HASH_START
    for b in token.encode():
        h = ((h ^ b) * ((1 << 40) + HASH_LOW)) & 0xFFFFFFFFFFFFFFFF
    return h % DIM


def _embed(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        v = np.bincount([_bucket(t) for t in (text or "").split()], minlength=DIM).astype(float)
        n = np.sqrt((v * v).sum())
        out.append(v / n if n else v)
    return pd.Series(out)


def embed_text(text: Column) -> Column:
    """hash_embedding for many texts: counting into 384 places is quicker in one array than in an expression."""
    return F.pandas_udf(_embed, "array<double>")(text)


def encode_batches(encode: Callable[[list[str]], list], prefix: str, dim: int, batch: int, texts: list[str | None]) -> list[list[float]]:
    """encode of prefixed texts, `batch` at a time; a batch that fails is tried text by text. Vectors of another length than dim are an error."""
    out: list[list[float]] = []
    for at in range(0, len(texts), batch):
        own = [prefix + (t or "") for t in texts[at : at + batch]]
        try:
            found = list(encode(own))
        except Exception:
            found = [v for t in own for v in encode([t])]
        out += [[float(x) for x in v] for v in found]
    if wrong := {len(v) for v in out} - {dim}:
        raise ValueError(f"vectors of {wrong} numbers instead of {dim}")
    return out


def model_embedding(load: Callable[[], Callable[[list[str]], list]], dim: int = DIM, prefix: str = "passage: ", batch: int = 32) -> Callable[[Column], Column]:
    """A text column to a vector column by a model. load() gives encode(texts); it is called once in each worker.

    Retrieval models tell stored texts from questions by a prefix: use `passage: ` for Engine(embed=...), `query: ` for
    embed_query.
    """

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series(encode_batches(encode, prefix, dim, batch, texts.tolist()))

    return lambda text: F.pandas_udf(embed, "array<double>")(text)
