"""The sliding chunker: windows of characters, cut at the last sentence end, with an overlap.

Each window's start depends on the last one's end, so a document is cut in one Arrow call; documents are independent.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunk_signal

WINDOW, OVERLAP, LEAST = 384, 64, 50
_END = re.compile(r"[.!?](?=\s|\Z)")


def cut(text: str, window: int = WINDOW, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a text."""
    total, out, start = len(text), [], 0
    if total < least or window <= 0:
        return out
    ends = [m.end() for m in _END.finditer(text)]
    while start < total:
        hard = min(total, start + window)
        k = bisect_right(ends, hard) - 1
        end = ends[k] if k >= 0 and ends[k] >= start + least else hard
        if end - start >= least:
            out.append((start, end))
        if end == total:
            break
        start = end - overlap if end - overlap > start else end
    return out


def chunk_pages(pages: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(doc_id, pages: array of (page_num, text)) to chunks; they don't cross pages, and are numbered through the document."""
    types = {"page": pa.int32(), "chunk_index": pa.int32(), "char_start": pa.int32(), "char_end": pa.int32(), "content": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, rows = [0], []
            for own in batch.column("pages").to_pylist():
                begin = len(rows)
                for p in own or []:
                    text = p["text"] or ""
                    first = len(rows) - begin
                    rows += [(p["page_num"], first + k, a, b, text[a:b]) for k, (a, b) in enumerate(cut(text, window, overlap, least))]
                ends.append(len(rows))
            columns = zip(*rows) if rows else [[]] * len(types)
            chunks = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks)], names=["doc_id", "chunks"])

    made = pages.select("doc_id", "pages").mapInArrow(run, "doc_id string, chunks array<struct<page:int,chunk_index:int,char_start:int,char_end:int,content:string>>")
    rows = made.select("doc_id", F.inline("chunks"))
    chunk_id = F.concat("doc_id", F.lit("#"), F.format_string("%05d", "chunk_index"))
    return rows.withColumn("chunk_id", chunk_id).withColumn("chunk_signal", chunk_signal(F.col("content")))


def chunk_texts(docs: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """Chunks of documents (doc_id, text) of one page."""
    one = F.array(F.struct(F.lit(None).cast("int").alias("page_num"), F.col("text").alias("text")))
    return chunk_pages(docs.select("doc_id", one.alias("pages")), window, overlap, least)
