"""Parsers: bytes of a file to pages of text. Each is a plain function; `parse_files` runs them in Arrow batches.

Failures become an error column, so one bad file doesn't stop a run. Models for images and speech are hooks.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import doc_class, filename, format_of, is_engine_output, is_supported
from .pdf import pdf_pages

#: Bytes of a JSON page, at most, where its structure allows.
JSON_PAGE = 16 * 1024
Page = tuple[int | None, str]


def markdown_pages(text: str) -> list[Page]:
    """Sections at headings of level 1 and 2, each below its path of headings; deeper headings stay in the text.

    The subset: ATX and setext headings, fenced code, list and quote markers, emphasis, code spans and links.
    """
    sections: list[tuple[list[str], list[str]]] = []
    stack: list[tuple[int, str]] = []
    path, body, fenced = [], [], False
    lines = text.splitlines()
    for k, line in enumerate(lines):
        if re.match(r"\s{0,3}(```|~~~)", line):
            fenced = not fenced
            continue
        level, title = 0, ""
        if not fenced:
            m = re.match(r"\s{0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$", line)
            if m:
                level, title = len(m[1]), m[2] or ""
            elif k and re.match(r"\s{0,3}(=+|-+)\s*$", line) and body and body[-1].strip() and lines[k - 1].strip():
                level, title = (1 if "=" in line else 2), body.pop()
        if not level:
            body.append(line if fenced else inline_text(line))
            continue
        if level <= 2 and ("".join(body).strip() or path):
            sections.append((path, body))
            body = []
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, inline_text(title).strip()))
        if level <= 2:
            path = [t for _, t in stack]
        else:
            body.append(stack[-1][1])
    sections.append((path, body))
    pages: list[Page] = []
    for own, lines_ in sections:
        inside = re.sub(r"\n{2,}", "\n", "\n".join(lines_)).strip()
        if inside or own:
            pages.append((None, (" > ".join(own) + "\n\n" if own else "") + inside))
    return pages or [(None, "")]


def inline_text(line: str) -> str:
    line = re.sub(r"^\s*(?:[-*+]|\d+[.)])\s+|^\s*>\s?", "", line)
    line = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", line)
    line = re.sub(r"(\*\*|__|`)(.+?)\1", r"\2", line)
    return re.sub(r"(?<!\w)[*_](.+?)[*_](?!\w)", r"\1", line)


def csv_pages(text: str) -> list[Page]:
    """One page: the header as row 1 with numbered columns, then the rows with the header's names; empty cells are skipped."""
    rows = [r for r in csv.reader(io.StringIO(text)) if r]
    out: list[str] = []
    names = [h.strip() for h in rows[0]] if rows else []
    for n, row in enumerate(rows, 1):
        cells = []
        for k, value in enumerate(row):
            if value.strip():
                name = names[k] if n > 1 and k < len(names) and names[k] else f"column_{k + 1}"
                cells.append(f"{name}: {value.strip()}")
        if cells:
            out += [f"row {n}", *cells, ""]
    return [(None, "\n".join(out).strip())]


def json_lines(path: str, value) -> list[str]:
    """`path: value` for each scalar below, keys in order."""
    if isinstance(value, dict) and value:
        return [x for k in sorted(value) for x in json_lines(f"{path}.{k}" if path else k, value[k])]
    if isinstance(value, list) and value:
        return [x for k, v in enumerate(value) for x in json_lines(f"{path}[{k}]", v)]
    if isinstance(value, (dict, list)) and not path:
        return []
    shown = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return [f"{path or 'value'}: {shown}"]


def json_pages(text: str) -> list[Page]:
    """Top-level parts packed in order to pages of JSON_PAGE bytes; a larger part is split along its own structure."""
    root = json.loads(text)

    def children(path: str, value) -> list[tuple[str, object]]:
        if isinstance(value, dict):
            return [(f"{path}.{k}" if path else k, value[k]) for k in sorted(value)]
        return [(f"{path}[{k}]", v) for k, v in enumerate(value)]

    def segments(path: str, value) -> list[str]:
        whole = "".join(x + "\n" for x in json_lines(path, value))
        if len(whole.encode()) <= JSON_PAGE or not isinstance(value, (dict, list)) or not value:
            return [whole]
        return [s for p, v in children(path, value) for s in segments(p, v)]

    parts = [s for p, v in children("", root) for s in segments(p, v)] if isinstance(root, (dict, list)) and root else segments("", root)
    pages, now = [], ""
    for s in parts:
        if now and len(now.encode()) + len(s.encode()) > JSON_PAGE:
            pages.append(now)
            now = ""
        now += s
    pages.append(now)
    texts = [p.rstrip() for p in pages if p.strip()] or [""]
    return [(k, t) for k, t in enumerate(texts, 1)]


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def xlsx_pages(data: bytes) -> list[Page]:
    """One page: each sheet's name in brackets, then its rows, cells apart by tabs."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter() if _local(t.tag) == "t"))
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out: list[str] = []
        for sheet in (s for s in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if _local(k) == "id")].lstrip("/")
            out.append(f"[{sheet.get('name')}]")
            for row in (r for r in ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter() if _local(r.tag) == "row"):
                cells: list[str] = []
                for c in row:
                    letters = re.match(r"[A-Z]*", c.get("r") or "")[0]
                    at = 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    cells += [""] * max(0, at - 1 - len(cells))
                    value = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                out.append("\t".join(cells))
    return [(None, "\n".join(out).strip())]


def docx_pages(data: bytes) -> list[Page]:
    """One page: the runs of top-level paragraphs, a line each; tables are skipped."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in ET.fromstring(z.read("word/document.xml")) if _local(e.tag) == "body")
    out = []
    for p in (e for e in body if _local(e.tag) == "p"):
        text = ""
        for e in p.iter():
            text += {"t": e.text or "", "tab": "\t", "br": "\n"}.get(_local(e.tag), "")
        out.append(text)
    return [(None, "\n".join(out).strip())]


def media_pages(name: str, kind: str, sidecar: str | None, hook: Callable[[], str] | None = None) -> list[Page]:
    """Text of an image, recording or film: its fresh sidecar, also if empty, else what the hook reads."""
    text = (sidecar if sidecar is not None else hook() if hook else "").strip()
    if kind == "image" and text:
        text = f"Image OCR text for {name}:\n{text}"
    return [(1 if kind == "image" else None, text)]


def parse_one(name: str, kind: str, data: bytes, sidecar: str | None = None, hooks: dict[str, Callable[[bytes], str]] | None = None) -> list[Page]:
    if kind in ("image", "video", "audio"):
        hook = (hooks or {}).get(kind)
        return media_pages(name, kind, sidecar, (lambda: hook(data)) if hook and data else None)
    by_bytes = {"xlsx": xlsx_pages, "docx": docx_pages, "pdf": pdf_pages}
    if kind in by_bytes:
        return by_bytes[kind](data)
    text = data.decode("utf-8")
    return {"csv": csv_pages, "json": json_pages}.get(kind, markdown_pages)(text)


def list_files(spark, root: str, infix: str = ".extracted.") -> DataFrame:
    """Supported files below root without the engine's own outputs: path, filename, format, class, size, mtime, hash and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    own = files.where(is_supported(F.col("path")) & ~is_engine_output(F.col("path"), infix))
    return own.select("path", filename(F.col("path")).alias("filename"), format_of(F.col("path")).alias("format"), doc_class(F.col("path")).alias("doc_class"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("hash"), "content")


def sidecars(spark, root: str, infix: str = ".extracted.") -> DataFrame:
    """(base, mtime, text) of the engine's outputs; base: the path up to the infix."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(is_engine_output(F.col("path"), infix))
    return files.select(F.substring_index("path", infix, 1).alias("base"), F.col("modificationTime").alias("side_mtime"), F.col("content").cast("string").alias("sidecar"))


def with_sidecars(files: DataFrame, sides: DataFrame) -> DataFrame:
    """files with the text of their fresh sidecar, or null; fresh: not older than the source."""
    base = F.regexp_replace("path", r"\.[^./]*$", "")
    own = files.withColumn("base", base).join(sides, "base", "left").drop("base")
    return own.withColumn("sidecar", F.when(F.col("side_mtime") >= F.col("mtime"), F.col("sidecar")))


def preprocess_plan(files: DataFrame) -> DataFrame:
    """(path, action): what each file needs before parsing: none, skip_fresh or run."""
    media = F.col("format").isin("image", "video", "audio")
    return files.select("path", F.when(~media, "none").when(F.col("sidecar").isNotNull(), "skip_fresh").otherwise("run").alias("action"))


def parse_files(files: DataFrame, hooks: dict[str, Callable[[bytes], str]] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(path, *keep, pages, error_msg) of files (path, filename, format, content, sidecar, *keep). A file is read once, one at a time."""
    page = pa.list_(pa.struct([("page_num", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for i in range(batch.num_rows):
                name, kind, data, side = (batch.column(c)[i].as_py() for c in ("filename", "format", "content", "sidecar"))
                try:
                    out.append([{"page_num": n, "text": t} for n, t in parse_one(name, kind, data, side, hooks)])
                    errors.append(None)
                except Exception as e:
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:500])
            own = [batch.column(c) for c in ("path", *keep)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(out, page), pa.array(errors, pa.string())], names=["path", *keep, "pages", "error_msg"])

    columns = list(dict.fromkeys(["path", "filename", "format", "content", "sidecar", *keep]))
    kept = "".join(f"{c} {files.schema[c].dataType.simpleString()}, " for c in keep)
    return files.select(*columns).mapInArrow(run, f"path string, {kept}pages array<struct<page_num:int,text:string>>, error_msg string")


def rows_as_text(table: DataFrame, key: str, number: str) -> DataFrame:
    """A table's rows as the text of a CSV page, without files: (key, block) with `row N` and `name: value` lines."""
    cells = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in table.columns if c not in (number,)]
    block = F.concat_ws("\n", F.concat(F.lit("row "), F.col(number).cast("string")), *cells)
    return table.select(F.col(key).alias("key"), block.alias("block"))


