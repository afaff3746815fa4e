"""The engine's verbs for a program that talks JSON-RPC 2.0, a message a line.

A verb is a row of VERBS: what it does, its arguments with their kinds and limits, and a call. Schemas, checks and
defaults all follow from that row.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, TextIO

from pyspark.sql import DataFrame, Row

from .engine import Engine

PROTOCOL, NAME, VERSION = "2025-06-18", "bracken", "2"
PARSE_ERROR, UNKNOWN_METHOD, BAD_PARAMS = -32700, -32601, -32602
#: Rows that a listing returns at most; there is no verb for more, and a message is made on the driver.
MOST_ROWS = 10_000


class BadArgument(ValueError):
    pass


@dataclass(frozen=True)
class Arg:
    """default None: must be given. Numbers above `most` are cut to it, as are defaults never."""

    kind: type
    about: str
    default: Any = None
    least: int | None = None
    most: int | None = None

    def schema(self) -> dict:
        names = {str: "string", int: "integer", bool: "boolean"}
        limits = {"minimum": self.least, "maximum": self.most, "default": self.default}
        return {"type": names[self.kind], "description": self.about} | {k: v for k, v in limits.items() if v is not None}

    def read(self, name: str, given: dict) -> Any:
        if name not in given:
            if self.default is None:
                raise BadArgument(f"argument {name} is missing")
            return self.default
        value = given[name]
        if type(value) is not self.kind or (self.kind is str and not value.strip()) or (self.kind is int and value < 0):
            raise BadArgument(f"argument {name} is not a valid {self.schema()['type']}")
        return min(value, self.most) if self.most is not None else value


@dataclass(frozen=True)
class Verb:
    about: str
    args: dict[str, Arg]
    call: Callable[..., Any]

    def run(self, engine: Engine, given: dict) -> dict:
        return self.call(engine, **{n: a.read(n, given) for n, a in self.args.items()})


def plain(value: Any) -> Any:
    """Rows, times and nested values as JSON has them."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


def rows(df: DataFrame) -> list:
    return [plain(r) for r in df.limit(MOST_ROWS).collect()]


def _graph(parts: tuple[DataFrame, DataFrame]) -> dict:
    return {"nodes": rows(parts[0]), "edges": rows(parts[1])}


_DIR = Arg(str, "The workdir whose index is meant.")
_ASK = {"workdir": _DIR, "q": Arg(str, "What is searched for."), "limit": Arg(int, "Results at most.", 10, 1, 50), "depth": Arg(int, "Steps along the graph.", 1, 0, 3)}
_CHUNK = {"workdir": _DIR, "chunk_id": Arg(str, "The chunk's id.")}
_EVIDENCE = "A link's evidence names the literal that both chunks hold and where; a semantic link says that they are alike, a manifest link that a list names both."
VERBS = {
    "search": Verb("Ranked chunks for a question: words, vectors, entities and references.", _ASK, lambda e, workdir, q, limit, depth: {"results": rows(e.search(workdir, q, limit, depth).orderBy("rank"))}),
    "context_pack": Verb(
        "Excerpts and links for a question, within a budget of tokens, with their sources.",
        _ASK | {"budget_tokens": Arg(int, "Tokens at most.", 6000, 1, 200_000), "include_graph": Arg(bool, "With links.", True)},
        lambda e, workdir, q, limit, depth, budget_tokens, include_graph: plain(e.context_pack(workdir, q, budget_tokens, limit, depth, include_graph).first()),
    ),
    "index_file": Verb("Indexes one file, again if it has changed.", {"workdir": _DIR, "path": Arg(str, "The file.")}, lambda e, workdir, path: e.index_file(workdir, path) | {"path": path}),
    "index_folder": Verb("Indexes the files of a folder that are new or have changed.", {"workdir": _DIR, "path": Arg(str, "The folder.")}, lambda e, workdir, path: e.index_folder(workdir, path) | {"path": path}),
    "get_index_stats": Verb("How many documents, chunks, entities and links there are.", {"workdir": _DIR}, lambda e, workdir: {r.name: r.value for r in e.get_index_stats(workdir).collect()}),
    "list_documents": Verb("The documents, those indexed last first.", {"workdir": _DIR}, lambda e, workdir: {"documents": rows(e.list_documents(workdir))}),
    "get_doc_chunks": Verb("A document's chunks, in order.", {"workdir": _DIR, "doc_id": Arg(str, "The document's id.")}, lambda e, workdir, doc_id: {"chunks": rows(e.get_doc_chunks(workdir, doc_id))}),
    "get_chunk_neighbors": Verb(f"What a chunk is linked with. {_EVIDENCE}", _CHUNK | {"depth": Arg(int, "Fifty links for each.", 1, 1, 3)}, lambda e, workdir, chunk_id, depth: {"neighbors": rows(e.get_chunk_neighbors(workdir, chunk_id, depth).orderBy("rank"))}),
    "get_graph_overview": Verb("The most linked chunks and the links among them.", {"workdir": _DIR, "limit": Arg(int, "Chunks at most.", 250, 1, 1000)}, lambda e, workdir, limit: _graph(e.get_graph_overview(workdir, limit))),
    "get_graph_neighborhood": Verb(
        f"The graph around a chunk. {_EVIDENCE}", _CHUNK | {"depth": Arg(int, "Steps.", 2, 1, 3), "limit": Arg(int, "Chunks at most.", 160, 1, 1000)},
        lambda e, workdir, chunk_id, depth, limit: _graph(e.get_graph_neighborhood(workdir, chunk_id, depth, limit)),
    ),
}


def tools() -> list[dict]:
    """The verbs with the schemas of their arguments."""
    out = []
    for name, verb in VERBS.items():
        required = [n for n, a in verb.args.items() if a.default is None]
        out.append({"name": name, "description": verb.about, "inputSchema": {"type": "object", "properties": {n: a.schema() for n, a in verb.args.items()}, "required": required}})
    return out


def call(engine: Engine, name: str, given: dict) -> dict:
    """A verb's result; what goes wrong inside is told in the result, not as an error of the protocol."""
    try:
        if name not in VERBS:
            raise BadArgument(f"no tool is called {name}")
        found = VERBS[name].run(engine, given)
    except Exception as e:
        return {"content": [{"type": "text", "text": f"{type(e).__name__}: {e}"[:2000]}], "isError": True}
    return {"content": [{"type": "text", "text": json.dumps(found, indent=2, ensure_ascii=False)}], "structuredContent": found, "isError": False}


def answer(engine: Engine, message: dict) -> dict | None:
    """The reply to a message; messages without an id get none."""
    key, method, params = message.get("id"), message.get("method"), message.get("params")
    if key is None:
        return None
    head = {"jsonrpc": "2.0", "id": key}
    fail = lambda code, text: head | {"error": {"code": code, "message": text}}
    if method == "tools/call":
        if not isinstance(params, dict) or not isinstance(params.get("name"), str) or not isinstance(params.get("arguments", {}), dict):
            return fail(BAD_PARAMS, "tools/call needs a name, and arguments by name")
        return head | {"result": call(engine, params["name"], params.get("arguments", {}))}
    known = {
        "initialize": lambda: {"protocolVersion": PROTOCOL, "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": NAME, "version": VERSION}},
        "ping": dict,
        "tools/list": lambda: {"tools": tools()},
    }
    return head | {"result": known[method]()} if method in known else fail(UNKNOWN_METHOD, f"there is no method {method}")


def serve(engine: Engine, source: TextIO, target: TextIO) -> None:
    """Reads messages and writes replies, a line each, until the source ends."""
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            reply = answer(engine, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": BAD_PARAMS, "message": "a message is an object"}}
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": f"no JSON: {e}"}}
        if reply is not None:
            target.write(json.dumps(reply, ensure_ascii=False) + "\n")
            target.flush()
