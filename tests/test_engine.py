"""The engine end to end on a folder, changes to a workspace, and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from bracken.functions.vectors import encode_batches
from bracken.plans import lifecycle as L
from bracken.plans import workspace
from bracken.plans.engine import AlreadyIndexing, ConcurrentChange, Engine
from bracken.sources.parse import list_files
from bracken.streaming.incremental import event_counts, watch_folder


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    prose = "The thermal printer INC-2026-ATLAS-014 failed on 21/05/2026 and was replaced by the field team. "
    (d / "printer_module.md").write_text("# Printer\n" + prose * 6)
    (d / "incident.txt").write_text("Field notes about INC-2026-ATLAS-014 and the replaced printer head in store nine. " * 5)
    (d / "log.csv").write_text("node,message\nsurya,pick and pack wave delayed for the morning shift today\n" * 3)
    (d / "data.json").write_text('{"audit": [{"id": 42, "notes": "retention audit of the archive was completed without findings"}]}')
    (d / "README.md").write_text("The printer replacement is described in printer_module.md and incident.txt of this folder, see there.")
    (d / "photo.png").write_bytes(b"\x89PNG")
    (d / "photo.extracted.txt").write_text("Invoice 77 approved by the finance office for the thermal printer order")
    (d / "bad.json").write_text("{not json")
    (d / "skip.exe").write_text("x")
    return d


@pytest.fixture(scope="module")
def engine(spark, folder, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('root')}")
    e.register_workdir("/w/one")
    assert e.index_folder("/w/one", f"file://{folder}") == {"indexed": 6, "skipped": 0, "failed": 1}
    return e


def test_index_and_search(engine):
    docs = {r.filename: r for r in engine.list_documents("/w/one").collect()}
    assert docs["bad.json"].status == "error" and docs["README.md"].doc_class == "reference" and len(docs) == 7
    found = engine.search("/w/one", ["printer replacement", "retention audit", "INC-2026-ATLAS-014"]).orderBy("query_id", "rank").collect()
    first = {r.query_id: r.filename for r in reversed(found)}
    assert first["1"] == "data.json" and first["2"] in ("printer_module.md", "incident.txt") and len({r.query_id for r in found}) == 3
    assert "photo.png" in {r.filename for r in engine.search("/w/one", "invoice finance").collect()}


def test_graph_and_pack(engine):
    edges = engine.workspace("/w/one").table("edges")
    assert edges.where("edge_type = 'shared_anchor' and weight = 0.9").count() > 0
    chunk = edges.where("edge_type = 'shared_anchor'").first().src_chunk
    near = engine.get_chunk_neighbors("/w/one", chunk).collect()
    assert near and any(r.evidence and r.evidence.anchor == "INC-2026-ATLAS-014" and r.evidence.src_span for r in near)
    assert engine.get_chunk_neighbors("/w/one", chunk, 0).count() == 0
    nodes, inside = engine.get_graph_neighborhood("/w/one", chunk)
    assert nodes.where("depth = 0").count() == 1 and inside.count() > 0 and engine.get_graph_overview("/w/one")[0].count() > 0
    pack = engine.context_pack("/w/one", "printer replacement").first()
    assert pack["items"] and pack.used <= 6000 and not pack.warnings


def test_unchanged_files_are_skipped_and_removed_ones_go(engine, folder):
    assert engine.index_folder("/w/one", f"file://{folder}")["skipped"] == 6
    doc = engine.list_documents("/w/one").where("filename = 'log.csv'").first().doc_id
    engine.remove_document("/w/one", doc)
    assert engine.get_doc_chunks("/w/one", doc).count() == 0
    left = engine.workspace("/w/one").tables()
    assert left["entities"].where(F.col("doc_id") == doc).count() == 0


WORDS = "granite harbour lantern meadow orchard pebble quarry ribbon saddle timber umbrella velvet willow zephyr anchor basket candle dragon ember falcon".split()


def story(k, *more):
    """Prose of its own for each k, with a name and a number that some share."""
    own = [WORDS[(k * j + j * j) % len(WORDS)] for j in range(1, 30)]
    return f"The report about Old Harbour and REF-{k % 3}-ALPHA was filed on 0{k % 9 + 1}/05/2026. " + " ".join(own) + ". " + " ".join(more)


@pytest.fixture
def no_links(spark, monkeypatch):
    """Links are made elsewhere; without them these tests take a fraction of the time."""
    monkeypatch.setattr(Engine, "build_edges", staticmethod(lambda tables, new=None: spark.createDataFrame([], L.SCHEMAS["edges"])))


def test_hidden_documents_take_no_places(spark, tmp_path, no_links):
    """Files that failed after they had been indexed keep their postings; searches must not see them, nor count them."""
    e = Engine(spark, f"file://{tmp_path}/root")
    (tmp_path / "in").mkdir()
    for k in range(12):
        (tmp_path / "in" / f"z{k}.json").write_text('{"note": "zebra zebra zebra zebra crossing number %d in the old town of the north"}' % k)
    (tmp_path / "in" / "good.md").write_text("A single zebra was seen near the river by the keeper, and nobody else was there to see it that day.")
    assert e.index_folder("/w", f"file://{tmp_path}/in") == {"indexed": 13, "skipped": 0, "failed": 0}
    assert e.search("/w", "zebra").where("filename = 'good.md'").isEmpty()  # ten of the others are better
    for k in range(12):
        (tmp_path / "in" / f"z{k}.json").write_text("{broken")
    assert e.index_folder("/w", f"file://{tmp_path}/in") == {"indexed": 0, "skipped": 1, "failed": 12}
    found = e.search("/w", "zebra").collect()
    assert [r.filename for r in found] == ["good.md"] and found[0].score_bm25 == 1.0 and found[0].score_vec > 0
    counts = e.workspace("/w").counts().first()
    assert counts.n == 1 and counts.avgdl == 21
    assert e.workspace("/w").table("postings").where("term = 'zebra'").count() == 13
    (tmp_path / "in" / "z0.json").write_text('{"note": "zebra zebra zebra zebra crossing is back in the old town of the north"}')
    assert e.index_folder("/w", f"file://{tmp_path}/in") == {"indexed": 1, "skipped": 1, "failed": 11}
    assert {r.filename for r in e.search("/w", "zebra").collect()} == {"good.md", "z0.json"} and e.workspace("/w").counts().first().n == 2


def test_indexing_in_steps_links_as_at_once(spark, tmp_path):
    """New documents are linked to all before them and nothing else is touched; replaced ones lose their old links."""
    e = Engine(spark, f"file://{tmp_path}/root")
    (tmp_path / "in").mkdir()
    for step in range(2):
        for k in range(6 * step, 6 * step + 6):
            (tmp_path / "in" / f"f{k:02}.md").write_text(story(k))
        assert e.index_folder("/w", f"file://{tmp_path}/in") == {"indexed": 6, "skipped": 6 * step, "failed": 0}
    ws = e.workspace("/w")
    state = ws.state()
    assert [len(state["tables"][n]) for n in ("chunks", "edges", "documents")] == [2, 2, 2]
    whole = Engine.build_edges(ws.tables())
    own = ws.table("edges")
    assert own.count() > 30 and own.exceptAll(whole).count() == 0 and whole.exceptAll(own).count() == 0
    (tmp_path / "in" / "f05.md").write_text(story(5, "Now it says more about the northern lighthouse keeper."))
    assert e.index_folder("/w", f"file://{tmp_path}/in") == {"indexed": 1, "skipped": 11, "failed": 0}
    after = ws.tables()
    assert after["chunks"].groupBy("chunk_id").count().where("count > 1").count() == 0 and after["documents"].count() == 12
    assert after["edges"].groupBy("src_chunk", "dst_chunk").count().where("count > 1").count() == 0
    ends = after["edges"].select(F.explode(F.array("src_chunk", "dst_chunk")).alias("chunk_id")).distinct()
    assert ends.join(after["chunks"], "chunk_id", "left_anti").count() == 0
    again = Engine.build_edges(after)
    replaced = after["documents"].where("filename = 'f05.md'").first().doc_id
    mine = lambda df: sorted((r.src_chunk, r.dst_chunk, round(r.weight, 9), r.edge_type, r.reason) for r in df.collect() if replaced in (r.src_chunk[:20], r.dst_chunk[:20]))
    assert len(mine(again)) > 3 and mine(after["edges"]) == mine(again)


def test_a_failed_write_changes_nothing(spark, tmp_path, monkeypatch, no_links):
    e = Engine(spark, f"file://{tmp_path}/root")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(story(1))
    e.index_folder("/w", f"file://{tmp_path}/in")
    ws = e.workspace("/w")
    before, state = {n: t.count() for n, t in ws.tables().items()}, ws.state()
    (tmp_path / "in" / "b.md").write_text(story(2))
    with monkeypatch.context() as m:
        m.setattr(Engine, "build_edges", staticmethod(lambda *a: 1 / 0))  # chunks, entities and the rest are written by then
        with pytest.raises(ZeroDivisionError):
            e.index_folder("/w", f"file://{tmp_path}/in")
    with monkeypatch.context() as m:
        m.setattr(type(ws), "_rename", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            e.index_folder("/w", f"file://{tmp_path}/in")
    assert ws.state() == state and {n: t.count() for n, t in ws.tables().items()} == before
    assert e.index_folder("/w", f"file://{tmp_path}/in") == {"indexed": 1, "skipped": 1, "failed": 0}
    named = {p for v in ws._versions() for own in json.loads(ws._get(f"{ws.home}/versions/{v}"))["tables"].values() for p in own}
    assert {f"{t}/{s}" for t in ("chunks", "edges", "gone") for s in ws._names(t)} <= named  # what the failed ones left is gone


def test_writers_exclude_one_another(spark, tmp_path, monkeypatch, no_links):
    e, other = Engine(spark, f"file://{tmp_path}/root"), Engine(spark, f"file://{tmp_path}/root")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(story(1))
    e.register_workdir("/w")
    with e.workspace("/w").locked():
        for refused in (lambda: other.index_folder("/w", f"file://{tmp_path}/in"), lambda: e.index_file("/w", f"file://{tmp_path}/in/a.md"), lambda: e.remove_document("/w", "x"), lambda: e.reset_index("/w")):
            with pytest.raises(AlreadyIndexing):
                refused()
        other.set_settings("/w", transcription="on")
        monkeypatch.setattr(workspace, "LOCK_SECONDS", 0)  # as if its holder were dead
        assert other.index_file("/w", f"file://{tmp_path}/in/a.md") == {"indexed": 1, "skipped": 0, "failed": 0}
    ws = e.workspace("/w")
    state = ws.state()
    ws.publish(state)
    with pytest.raises(ConcurrentChange):
        ws.publish(state)
    assert e.get_settings("/w") == {"transcription": "on"} and e.list_documents("/w").count() == 1


def test_many_versions_are_rewritten_and_old_ones_deleted(spark, tmp_path, monkeypatch, no_links):
    monkeypatch.setattr(workspace, "MOST_SEGMENTS", 2)
    e = Engine(spark, f"file://{tmp_path}/root")
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"f{k}.md").write_text(story(k))
        (tmp_path / "in" / "f0.md").write_text(story(0, "again " * k))
        e.index_folder("/w", f"file://{tmp_path}/in")
    ws = e.workspace("/w")
    assert len(ws._versions()) <= workspace.KEPT_VERSIONS and max(len(v) for v in ws.state()["tables"].values()) <= 2
    assert e.list_documents("/w").count() == 3 and ws.table("chunks").groupBy("chunk_id").count().where("count > 1").count() == 0
    e.reset_index("/w")
    assert all(t.count() == 0 for n, t in ws.tables().items()) and e.list_workdirs() == ["/w"] and e.search("/w", "granite").count() == 0
    assert L.changed_files(list_files(spark, f"file://{tmp_path}/in"), ws.table("documents")).count() == 3


def test_old_segments_are_filled_in(spark, tmp_path):
    """A segment written before columns were added reads like others; so it does when it is rewritten."""
    e = Engine(spark, f"file://{tmp_path}/root")
    e.register_workdir("/w")
    ws = e.workspace("/w")
    spark.createDataFrame([("d1", "/x/readme.md", "indexed", 1)], "doc_id string, path string, status string, segment long").write.parquet(f"{ws.home}/documents/old")
    spark.createDataFrame([("d1", "d1#00000", "Document anchors: REF-1-ALPHA REF-2-ALPHA", 1)], "doc_id string, chunk_id string, content string, segment long").write.parquet(f"{ws.home}/chunks/old")
    spark.createDataFrame([("d1#00000", [1.0], 1)], "chunk_id string, embedding array<double>, segment long").write.parquet(f"{ws.home}/vectors/old")
    spark.createDataFrame([("d1#00000", "d1", "Old  Harbour", 1)], "chunk_id string, doc_id string, value string, segment long").write.parquet(f"{ws.home}/entities/old")
    ws.publish(ws.state(), tables={n: [f"{n}/old"] for n in ("documents", "chunks", "vectors", "entities")})
    for _ in range(2):
        t = ws.tables()
        assert t["documents"].first().doc_class == "reference" and t["chunks"].first().chunk_signal == "anchor_list"
        assert t["vectors"].first().doc_id == "d1" and t["entities"].first().normalized_value == "old harbour"
        state = ws.state()
        ws.publish(state, tables={n: [ws.write(n, 9, ws.table(n, state))] for n in state["tables"]})


def test_another_embedding_empties_the_index(spark, tmp_path, no_links):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"f{k}.md").write_text(story(k))
    old, new = Engine(spark, f"file://{tmp_path}/root"), Engine(spark, f"file://{tmp_path}/root", embed=lambda c: F.array(F.length(c).cast("double"), F.lit(1.0)), embed_version="two")
    old.index_folder("/w", f"file://{tmp_path}/in")
    id_before = {r.doc_id for r in old.list_documents("/w").collect()}
    assert new.index_folder("/w", f"file://{tmp_path}/in") == {"indexed": 2, "skipped": 0, "failed": 0}
    assert {len(r.embedding) for r in new.workspace("/w").table("vectors").collect()} == {2} and {r.doc_id for r in new.list_documents("/w").collect()} == id_before


def test_model_embeddings_tell_queries_from_passages():
    calls = []

    def encode(texts):
        calls.append(texts)
        if any("bad" in t for t in texts) and len(texts) > 1:
            raise RuntimeError("batch refused")
        return [[float(len(t)), 1.0] for t in texts]

    out = encode_batches(encode, "passage: ", 2, 3, ["a", None, "bad", "dddd"])
    assert out == [[10.0, 1.0], [9.0, 1.0], [12.0, 1.0], [13.0, 1.0]] and calls[0] == ["passage: a", "passage: ", "passage: bad"] and len(calls) == 5
    with pytest.raises(ValueError):
        encode_batches(encode, "query: ", 3, 8, ["x"])


def test_cancelled_indexing_publishes_nothing(spark, tmp_path):
    import threading
    import time

    def slow(data):
        time.sleep(30)
        return "text"

    e = Engine(spark, f"file://{tmp_path}/root", hooks={"image": slow})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p.png").write_bytes(b"x")
    failed = []

    def run():
        try:
            e.index_folder("/w", f"file://{tmp_path}/in")
        except Exception as x:
            failed.append(x)

    t = threading.Thread(target=run)
    t.start()
    for _ in range(100):
        time.sleep(0.2)
        e.cancel_indexing()
        if not t.is_alive():
            break
    t.join(60)
    assert failed and e.list_workdirs() == []
    with e.workspace("/w").locked():
        pass


def test_workdirs_are_apart(engine):
    engine.register_workdir("/w/two")
    assert engine.list_workdirs() == ["/w/one", "/w/two"] and engine.list_documents("/w/two").count() == 0
    engine.set_settings("/w/two", transcription="on")
    assert engine.get_settings("/w/two")["transcription"] == "on"
    engine.delete_workdir("/w/two")
    assert engine.list_workdirs() == ["/w/one"]


def test_edge_upserts(spark):
    rows = [("a", "b", 0.5, "same_doc", "r1", 1), ("a", "b", 0.8, "semantic", "r2", 2), ("a", "b", 0.8, "shared_anchor", "r3", 3), ("a", "c", 0.9, "shared_anchor", "x", 1)]
    new = spark.createDataFrame(rows, "src_chunk string, dst_chunk string, weight double, edge_type string, reason string, seq long")
    out = {r.dst_chunk: r for r in L.upsert_edges(new.limit(0), new, "seq").collect()}
    assert (out["b"].weight, out["b"].edge_type, out["b"].reason) == (0.8, "semantic", "r3") and out["c"].reason == "x"


def test_stream(spark, engine, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "late.md").write_text("# Late\n" + "A late file about the harbour crane and its yearly inspection by the port office. " * 4)
    engine.register_workdir("/w/stream")
    watch_folder(engine, "/w/stream", f"file://{tmp_path}/in", f"file://{tmp_path}/cp").awaitTermination(120)
    assert engine.list_documents("/w/stream").count() == 1
    counts = event_counts(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    assert counts.agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
