"""Counts that are made where a document is read agree with those over the index's rows, and exchange no row of a chunk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bracken import catalogue
from bracken.functions import text as T
from bracken.operators import entities as N
from bracken.operators import tallies as Y
from bracken.operators.chunking import chunk_texts

LINE = "Order ORD-{0}-F by Anna Zoe shipped on 0{0}/10/1998 under NAT-3-ASIA. Priority Handling for BUILDING Segment goods."
TEXTS = [
    *["\n".join(LINE.format(k % m + 1) for k in range(n)) for n, m in ((1, 1), (9, 3), (40, 9))],
    "Émile Zola. " + LINE.format(1) + "\n" + LINE.format(2), "title: Region card tags: trade AB-C-D NAT-3-ASIA and the others of it", LINE.format(3) + " Anchors: " + "AB-C-D " * 60,
    LINE.format(4) + " " * 500 + LINE.format(4), "\x1c" * 60 + "\n" * 400, "\x0b" * 80, "short", "", None,
]


@pytest.fixture
def documents(spark):
    return spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(TEXTS)], "doc_id string, text string")


def _values(entities):
    rows = entities.groupBy("entity_type", F.coalesce("normalized_value", "value")).agg(F.count("*"), F.countDistinct("doc_id")).collect()
    return sorted(map(tuple, rows))


def test_values_of_documents(spark, documents):
    want = _values(N.extract_entities(chunk_texts(documents).where("chunk_signal = 'content'")))
    assert sorted(map(tuple, Y.value_counts(documents).collect())) == want != []


@pytest.mark.parametrize("length", [3, 1024])
def test_a_document_is_counted_once_however_long(spark, documents, monkeypatch, length):
    monkeypatch.setattr(Y, "SLICE", length)
    plain = documents.where(T.is_ascii(F.col("text")) & ~T.is_marked(F.col("text")))
    found: dict = {}
    for batch in Y._count_values(iter(plain.select("text").toArrow().to_batches())):
        for kind, value, n, docs in zip(*[c.to_pylist() for c in batch.columns]):
            had = found.get((kind, value), (0, 0))
            found[kind, value] = had[0] + n, had[1] + docs
    assert sorted((*k, *v) for k, v in found.items()) == _values(N.extract_entities(chunk_texts(plain).where("chunk_signal = 'content'")))


def test_terms_of_chunks(spark, documents):
    want = N.terms_of(N.extract_entities(chunk_texts(documents))).select("chunk_id", "term").distinct().groupBy("term").agg(F.count("*"))
    assert sorted(map(tuple, Y.term_counts(documents).collect())) == sorted(map(tuple, want.collect())) != []
    assert Y.term_counts(documents.limit(0)).count() == Y.value_counts(documents.limit(0)).count() == 0


def test_only_counts_leave_a_task(spark):
    for name in ("join_03_shared_values", "set_03_distinct_terms"):
        df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "_count_" in plan and "Join" not in plan


def test_tokens_are_read_a_slice_at_a_time():
    own, kind, which, sure, values, normals = N.AsciiReader()([LINE.format(1), "", "goods Goods AB-C-D 1/2/03 1/2/03"])
    rows = [(o, N.KINDS[k], values[w].as_py(), normals[w].as_py()) for o, k, w in zip(own.tolist(), kind.tolist(), which.tolist())]
    assert rows[:3] == [(0, "ANCHOR", "ORD-1-F", "ORD-1-F"), (0, "ANCHOR", "NAT-3-ASIA", "NAT-3-ASIA"), (0, "DATE", "01/10/1998", "1998-10-01")]
    assert [r for r in rows if r[0] == 2] == [
        (2, "ANCHOR", "AB-C-D", "AB-C-D"), (2, "DATE", "1/2/03", "2003-02-01"), (2, "DATE", "1/2/03", "2003-02-01"),
        (2, "PHRASE", "goods Goods", "goods goods"), (2, "PHRASE", "Goods AB", "goods ab"), (2, "PHRASE", "AB C", "ab c"), (2, "PHRASE", "C D", "c d"), (2, "PROPER", "Goods", "goods"), (2, "KEYWORD", "goods", "goods"),
    ]
    assert np.all(np.diff(own) >= 0)
