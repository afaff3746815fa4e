"""What keeps large tables within bounds: fast readers that agree with the expressions, and pairs that aren't written."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from bracken.functions import text as T
from bracken.operators import edges as E
from bracken.operators import entities as N
from bracken.operators import search as S
from bracken.operators.lexical import bm25, postings
from bracken.plans.corpora import literal_queries, trade

TEXTS = [
    "Order ORD-15-F by Customer#000000010 shipped on 03/10/1998 under NAT-3-ASIA. Priority Handling for BUILDING Segment goods.",
    "ORD-1-F ORD-1-F A-B-C AB-C AB-C-D_ XAB-C-D 45/13/98 1/2-3 1-2-1999 12/11/20001 31-12-07 00/01/99 9/9/123",
    "the The Theory the-ory don't 'quoted' ...dots. After. Before after goods goods Goods segment segment. x.y Z.Z a1b2 Ab",
    "", " \t ", "under_score Snake_Case " + "A" * 31 + " " + "Bcde " * 12, "\x1cone\x1dTwo\x85", "I-II-III-" + "X" * 70,
]


def test_ascii_reader_finds_what_the_expressions_find(spark):
    df = spark.createDataFrame([(f"c{k}", "d", t) for k, t in enumerate(TEXTS + [None])], "chunk_id string, doc_id string, content string")
    slow = df.select("chunk_id", "doc_id", F.posexplode(N._by_expressions(F.col("content"))).alias("seq", "hit")).select("chunk_id", "doc_id", "seq", "hit.*")
    slow = slow.withColumn("normalized_value", T.normalize_entity(F.col("value")))
    found = N.extract_entities(df)
    assert found.columns == slow.columns
    assert sorted(found.collect()) == sorted(slow.collect()) != []
    assert "MapInArrow" in found._jdf.queryExecution().toString()


def test_postings_of_ascii_and_other_texts(spark):
    df = spark.createDataFrame([("a", "d", "Goods, goods " + "x" * 41 + " 7up"), ("b", "d", "Émile émile goods"), ("c", "d", ""), ("e", "d", None)], "chunk_id string, doc_id string, content string")
    assert sorted(map(tuple, postings(df).collect())) == [("7up", "a", "d", 1, 3), ("goods", "a", "d", 2, 3), ("goods", "b", "d", 1, 3), ("émile", "b", "d", 2, 3)]
    assert "MapInArrow" in postings(df)._jdf.queryExecution().toString()


def test_signal_at_a_glance(spark):
    texts = TEXTS + [None, "\n ", "TITLE: x AB-C-D", "Related\nAnchors: AB-C-D EF-G-H", "anchors here"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    assert df.where(~T.chunk_signal(F.col("c")).eqNullSafe(T._signal_of_marked(F.col("c")))).count() == 0


def test_pairs_inside_a_document_are_not_written(spark):
    c = trade(spark, "/root/testdata/sf0.001")
    assert c.links.where("edge_type = 'same_doc'").isEmpty()
    inside = E.same_doc(c.chunks).count()
    assert c.edges.count() == c.links.count() + inside > inside > 0
    # Whoever asks for other kinds doesn't make them.
    assert "Join" not in S.expandable(c.edges)._jdf.queryExecution().optimizedPlan().toString()


def test_merge_breaks_ties_as_upserts_would(spark):
    schema = "src_chunk string, dst_chunk string, weight double, edge_type string, reason string"
    one = spark.createDataFrame([("a", "b", 0.5, "one", "z"), ("a", "b", 0.5, "one", "y"), ("a", "b", 0.4, "one", "a")], schema)
    two = spark.createDataFrame([("a", "b", 0.5, "two", "q"), ("a", "b", 0.5, "two", "p"), ("c", "d", 0.1, "two", None)], schema)
    merged = E.merge_edges(one, two)
    assert sorted(map(tuple, merged.collect())) == [("a", "b", 0.5, "one", "p"), ("c", "d", 0.1, "two", None)]
    assert "Window" not in merged._jdf.queryExecution().optimizedPlan().toString()


def test_families_read_entities_that_are_joined_once(spark):
    c = trade(spark, "/root/testdata/sf0.001")
    for name in ("shared_anchor", "shared_entity", "manifest_overlap"):
        build = getattr(E, name)
        assert sorted(build(c.told, c.chunks, c.arrived).collect()) == sorted(build(c.entities, c.chunks, c.arrived).collect())
    assert "LeftSemi" not in c.edge_families()["shared_entity"]._jdf.queryExecution().optimizedPlan().toString()


def _joins(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_of_frequent_terms_stay_where_they_are(spark):
    c = trade(spark, "/root/testdata/sf0.001")
    q = literal_queries(spark)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plain = sorted(bm25(q, c.postings, c.stats, 10, c.visible).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # Tables of no known size: the terms are sent to the postings even so.
        assert "SortMergeJoin" not in _joins(bm25(q, c.postings, c.stats, 10))
        assert "Join" not in _joins(S.entity_candidates(q, c.entities, 10))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert sorted(bm25(q, c.postings, c.stats, 10, hidden=c.hidden).collect()) == plain != []


def test_entity_scorer_agrees_with_the_expression(spark):
    asked = ["Priority Handling for goods", "ORD-15-F", "a", "goods", "x goods y", "Priority  a b", "Émile Zola", ""]
    values = ["priority handling", "goods", "ORD-15-F", "ord 15 f", "a", "x goods", "handling goods goods", "émile", "é", "priority\thandling", "b a", "", None, "priority handling for goods again"]
    q = spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(asked)], "query_id string, text string")
    e = spark.createDataFrame([(f"c{k % 5}", v) for k, v in enumerate(values)], "chunk_id string, normalized_value string")
    pairs = q.select("query_id", T.normalize_entity(F.col("text")).alias("qn")).withColumn("qt", T.entity_terms(F.col("qn"))).where((F.col("qn") != "") & (F.size("qt") > 0)).crossJoin(e)
    slow = pairs.withColumn("m", S.entity_match(F.col("qn"), F.col("qt"), F.col("normalized_value"))).where("m > 0").groupBy("query_id", "chunk_id").agg(F.round(F.sum("m"), 9))
    found = S.entity_candidates(q, e, None).withColumn("score", F.round("score", 9))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, slow.collect())) != []


def test_edges_at_chunks_are_those_of_all_edges(spark):
    c = trade(spark, "/root/testdata/sf0.001")
    nodes = c.chunks.where("doc_id in ('cust-000000010', 'nation-003', 'title-2') or chunk_id like 'region-%'").select("chunk_id")
    found = c.edges_at(nodes)
    want = E.touching(c.edges, nodes)
    assert sorted(found.collect()) == sorted(want.collect())
    assert {r.edge_type for r in found.collect()} >= {"same_doc", "shared_anchor", "shared_entity"}


def test_names_are_cut_where_the_texts_are(spark):
    texts = spark.createDataFrame([("q", "see cust_1.txt and xcust_2.txt. also cust_1.txt"), ("p", "cust_2.txtx")], "query_id string, ref string")
    names = spark.createDataFrame([("cust_1.txt",), ("CUST_2.txt",), ("cust_3.txt",)], "filename string")
    found = S.mentioned(texts, names)
    assert sorted(map(tuple, found.collect())) == [("p", "CUST_2.txt"), ("q", "CUST_2.txt"), ("q", "cust_1.txt")]
    # Runs are cut before anything is exchanged.
    assert not any("HashAggregate(keys=[query_id" in x and "run#" in x for x in _joins(found).splitlines())


def test_texts_are_neither_laid_out_by_trigram_nor_ranked(spark, monkeypatch):
    c, written, write = trade(spark, "/root/testdata/sf0.001"), {}, S.staged
    monkeypatch.setattr(S, "staged", lambda df, label: (written.update({label: df.columns}), write(df, label))[1])
    q = literal_queries(spark).withColumn("embedding", F.lit(None).cast("array<double>"))
    S.hybrid_search(q, c.documents, c.chunks, c.entities, c.vectors.limit(0), c.postings, c.stats, visible=c.visible, hidden=c.hidden)
    assert written["grams"] == ["chunk_id", "gram"] and written["files"] == ["query_id", "filename"]
    assert "content" not in written["scored"] + written["ranked"] and "hidden" not in written


def test_products_of_a_block_of_queries_are_bounded():
    r = np.random.default_rng(1)
    q, x = r.normal(size=(256, 8)), r.normal(size=(3 * S.VECTORS + 5, 8))
    unit, keys = x / np.linalg.norm(x, axis=1, keepdims=True), np.array([f"{k:06d}" for k in range(len(x))], object)
    best = S._Best([str(k) for k in range(len(q))], q, 5)
    tracemalloc.start()
    best.add(unit, keys)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * len(q) * len(x) * 8  # the products of all at once, their rounded values and a copy of these are three
    sims = np.round(np.clip(best.q @ unit.T, 0, 1), 9)
    want = {(str(k), keys[j]) for k, row in enumerate(sims) for j in np.argsort(-row, kind="stable")[:5]}
    assert set(zip(best.found()["query_id"], best.found()["chunk_id"])) == want
