"""Retrieval quality on a corpus with known answers, and the verbs over JSON-RPC."""

import io
import json

import benchmark_corpus
import pytest
from pyspark.sql import functions as F

from bracken.operators import evaluate as V
from bracken.plans import rpc
from bracken.plans.engine import Engine


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("corpus")


@pytest.fixture(scope="module")
def engine(spark, folder, tmp_path_factory):
    files = benchmark_corpus.build(folder)
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('index')}")
    assert len(files) == 52 and e.index_folder("/b", f"file://{folder}") == {"indexed": 52, "skipped": 0, "failed": 0}
    return e


def test_quality(spark, engine):
    asked = benchmark_corpus.questions()
    assert len(asked) == 15
    found = engine.search("/b", [text for text, _, _ in asked]).select("query_id", "rank", "filename")
    cases = spark.createDataFrame([(str(k), files, n) for k, (_, files, n) in enumerate(asked)], "query_id string, relevant array<string>, k int")
    out = {r.query_id: r for r in V.metrics(found, cases).collect()}
    assert all(r.recall_at_k > 0 for r in out.values()), [(asked[int(q)], r.files) for q, r in out.items() if r.recall_at_k == 0]
    assert sum(r.recall_at_k for r in out.values()) / 15 >= 0.95 and sum(r.top1 for r in out.values()) >= 12
    metrics = V.graph_metrics(engine.workspace("/b").table("chunks"), engine.workspace("/b").table("edges")).first()
    assert metrics.evidence_edges > 20
    first = {q: r.files[0] for q, r in out.items()}
    assert not set(first.values()) & {"readme_master.md", "manifest.json"}


def test_verbs(engine, folder):
    lines = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "ping"}, {"id": 3, "method": "tools/list"}, {"id": 4, "method": "no/such"}, {"id": 5, "method": "tools/call", "params": {"arguments": {}}},
        *({"id": 10 + k, "method": "tools/call", "params": {"name": n, "arguments": {"workdir": "/b"} | a}} for k, (n, a) in enumerate([
            ("search", {"q": "payment reconciliation ledger", "limit": 3}), ("search", {"q": "  "}), ("search", {"q": "x", "limit": "3"}), ("search", {"q": "x", "limit": True}), ("nothing", {}), ("get_index_stats", {}), ("list_documents", {}),
            ("context_pack", {"q": "retention policy audit", "budget_tokens": 300}), ("index_file", {"path": f"file://{folder}/syslog_01.txt"}), ("get_graph_overview", {"limit": 5}),
        ])),
    ]
    target = io.StringIO()
    rpc.serve(engine, io.StringIO("\n".join(map(json.dumps, lines)) + "\n\n{broken\n[1]\n"), target)
    out = {r["id"]: r for r in map(json.loads, target.getvalue().splitlines()) if r["id"] is not None}
    lost = [json.loads(x)["error"]["code"] for x in target.getvalue().splitlines() if json.loads(x)["id"] is None]
    assert out[1]["result"]["protocolVersion"] and out[2]["result"] == {} and lost == [rpc.PARSE_ERROR, rpc.BAD_PARAMS]
    tools = {t["name"]: t["inputSchema"] for t in out[3]["result"]["tools"]}
    assert len(tools) == 10 and tools["search"]["required"] == ["workdir", "q"] and tools["search"]["properties"]["limit"] == {"type": "integer", "description": "Results at most.", "minimum": 1, "maximum": 50, "default": 10}
    assert out[4]["error"]["code"] == rpc.UNKNOWN_METHOD and out[5]["error"]["code"] == rpc.BAD_PARAMS
    told = {k: out[10 + k]["result"] for k in range(10)}
    found = told[0]["structuredContent"]["results"]
    assert len(found) == 3 and [r["rank"] for r in found] == [1, 2, 3] and max(found, key=lambda r: r["score"])["filename"] == "billing_module.md"
    assert all(told[k]["isError"] for k in (1, 2, 3, 4)) and told[5]["structuredContent"]["documents"] == "52"
    assert len(told[6]["structuredContent"]["documents"]) == 52 and json.loads(told[6]["content"][0]["text"]) == told[6]["structuredContent"]
    pack = told[7]["structuredContent"]
    assert pack["used"] <= 300 and pack["items"][0]["chunk_id"] and told[8]["structuredContent"]["skipped"] == 1
    nodes = told[9]["structuredContent"]["nodes"]
    assert len(nodes) == 5
    near = rpc.call(engine, "get_chunk_neighbors", {"workdir": "/b", "chunk_id": nodes[0]["chunk_id"]})["structuredContent"]["neighbors"]
    around = rpc.call(engine, "get_graph_neighborhood", {"workdir": "/b", "chunk_id": nodes[0]["chunk_id"], "depth": 1})["structuredContent"]
    chunks = rpc.call(engine, "get_doc_chunks", {"workdir": "/b", "doc_id": nodes[0]["doc_id"]})["structuredContent"]["chunks"]
    assert near and len(around["nodes"]) > 1 and around["edges"] and {c["doc_id"] for c in chunks} == {nodes[0]["doc_id"]}
    assert rpc.VERBS["search"].args["limit"].read("limit", {"limit": 99}) == 50 and engine.list_documents("/b").where(F.col("status") == "indexed").count() == 52
