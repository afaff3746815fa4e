"""What a corpus's entities add up to, counted where a document is read: no row of a chunk or a document is exchanged.

A document is one row, so who holds a value or a term twice is known there; only counts by value or term leave a task.
ASCII documents are cut and read in one Arrow call; the others by the operators that index them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_ascii, is_marked
from ..plans.staging import staged
from .chunking import chunk_texts, cut
from .entities import KINDS, SLICE, AsciiReader, extract_entities, terms_of

#: As \S in an expression.
_SEEN = re.compile(r"[^ \t\n\x0b\f\r]").search


def _slices(batches: Iterator[pa.RecordBatch], content: bool = False) -> Iterator[tuple[list[str], list[int]]]:
    """The chunks of some whole documents, about SLICE, and the number of each one's document among these. content: blank ones are left out."""
    for batch in batches:
        chunks, own, n = [], [], 0
        for text in batch.column("text").to_pylist():
            pieces = [text[a:b] for a, b in cut(text)]
            pieces = [p for p in pieces if _SEEN(p)] if content else pieces
            chunks += pieces
            own += [n] * len(pieces)
            n += 1
            if len(chunks) >= SLICE:
                yield chunks, own
                chunks, own, n = [], [], 0
        if chunks:
            yield chunks, own


def _numbered(names: dict[str, int], values: list[str]) -> list[int]:
    return [names.setdefault(v, len(names)) for v in values]


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read = AsciiReader()
    for chunks, _ in _slices(batches):
        for at in range(0, len(chunks), SLICE):
            own, _, which, _, _, normals = read(chunks[at : at + SLICE])
            held, which = np.unique(which, return_inverse=True)
            names: dict[str, int] = {}
            terms = [_numbered(names, [t for t in v.split() if len(t) >= 2]) for v in normals.take(pa.array(held)).to_pylist()]
            if names:
                size = np.fromiter(map(len, terms), np.int64, len(terms))
                flat = np.fromiter(chain.from_iterable(terms), np.int64, size.sum())
                n = size[which]
                place = np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[which] - (np.cumsum(n) - n), n)
                pairs = np.unique(np.repeat(own, n) * len(names) + flat[place])
                yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(np.bincount(pairs % len(names), minlength=len(names)))], ["term", "n"])


def term_counts(documents: DataFrame) -> DataFrame:
    """(term, n): how many chunks of the documents (doc_id, text; a row each) have an entity with the term."""
    plain = is_ascii(F.col("text"))
    read = documents.where(plain).select("text").mapInArrow(_count_terms, "term string, n long")
    other = extract_entities(staged(chunk_texts(documents.where(~plain).select("doc_id", "text")), "others"))
    other = terms_of(other).select("chunk_id", "term").dropDuplicates().groupBy("term").agg(F.count("*").alias("n"))
    return read.unionByName(other).groupBy("term").agg(F.sum("n").alias("n"))


def _count_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    read, kinds = AsciiReader(), pa.array(KINDS)
    for chunks, documents in _slices(batches, content=True):
        names: dict[str, int] = {}
        docs, keys = [], []
        # A document longer than a slice is read in some, but counted once.
        for at in range(0, len(chunks), SLICE):
            own, kind, which, _, _, normals = read(chunks[at : at + SLICE])
            held, which = np.unique(which, return_inverse=True)
            value = np.array(_numbered(names, normals.take(pa.array(held)).to_pylist()), np.int64)
            docs.append(np.array(documents[at : at + SLICE], np.int64)[own])
            keys.append(value[which] * len(KINDS) + kind)
        if names:
            most = len(names) * len(KINDS)
            key = np.concatenate(keys)
            n, held = np.bincount(key, minlength=most), np.bincount(np.unique(np.concatenate(docs) * most + key) % most, minlength=most)
            key = np.flatnonzero(n)
            value = pa.array(list(names), pa.string()).take(pa.array(key // len(KINDS)))
            yield pa.RecordBatch.from_arrays([kinds.take(pa.array(key % len(KINDS))), value, pa.array(n[key]), pa.array(held[key])], ["entity_type", "value", "n", "docs"])


def value_counts(documents: DataFrame) -> DataFrame:
    """(entity_type, value, n, docs): the entities of content chunks by normal form, and how many of the documents (doc_id, text; a row each) have them."""
    plain = is_ascii(F.col("text")) & ~is_marked(F.col("text"))
    read = documents.where(plain).select("text").mapInArrow(_count_values, "entity_type string, value string, n long, docs long")
    other = extract_entities(staged(chunk_texts(documents.where(~plain).select("doc_id", "text")).where("chunk_signal = 'content'"), "others"))
    keys = ["entity_type", F.coalesce("normalized_value", "value").alias("value")]
    other = other.groupBy("doc_id", *keys).agg(F.count("*").alias("n")).groupBy("entity_type", "value").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    return read.unionByName(other).groupBy("entity_type", "value").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
