"""Literal cases of the text, vector, parsing and ranking operators."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from bracken.functions import text as T
from bracken.functions.vectors import cosine, embed_text, hash_embedding
from bracken.operators import edges as E
from bracken.operators import evaluate as V
from bracken.operators import search as S
from bracken.operators.chunking import cut
from bracken.sources import parse as P


def values(spark, texts, f):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.v for r in df.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]


def test_chunker():
    assert cut("Short sentence.", 512, 64, 50) == []
    text = ". ".join(c * 240 for c in "abc") + "."
    chunks = cut(text, 512, 64, 50)
    assert len(chunks) == 2 and chunks[1][0] == chunks[0][1] - 64
    assert cut("x" * 1000)[-1][1] == 1000
    assert [b - a <= 384 for a, b in cut("word. " * 400)]


def test_signal(spark):
    texts = [
        "Document anchors: NRC-COMPANY-001 ATLAS-POS-2026 INC-2026-ATLAS-014",
        "The printer INC-2026-ATLAS-014 was replaced because the thermal head failed during the promotion window of the store.",
        "title: Store list company: Acme tags: pos anchors: NRC-COMPANY-001 ATLAS-POS-2026",
        "   ",
    ]
    assert values(spark, texts, T.chunk_signal) == ["anchor_list", "content", "metadata", "metadata"]


def test_anchors_and_dates(spark):
    texts = ["VID-APPROVAL-005 INC-2026-ATLAS-014 APPROVAL-Q-ATLAS SHIP-NODE-SURYA", "INC-014 Q1-2026 vid-approval-005"]
    assert values(spark, texts, lambda c: F.size(T.anchors(c))) == [4, 0]
    assert values(spark, ["on 21/05/2026 and 1-1-2027.", "2026-05-21"], lambda c: F.array_join(T.dates(c), "|")) == ["21/05/2026|1-1-2027", "26-05-21"]
    assert values(spark, ["21/05/2026", "21-05-26", "2026-05-21", "31/13/2020", "a/b/c", "1/2"], T.normalize_date) == ["2026-05-21"] * 3 + [None] * 3


def test_normal_forms(spark):
    assert values(spark, ["VID-APPROVAL-005", "Thermal  Printer!", "Émile-Zola"], T.normalize_entity) == ["VID-APPROVAL-005", "thermal printer", "émile zola"]
    assert values(spark, ["a+b (c)"], T.sanitize_query) == ["a b  c "]
    assert values(spark, ["a" * 401, ""], T.estimate_tokens) == [101, 1]


@pytest.mark.parametrize("name, kind", [("manifest.json", "reference"), ("README-old.txt", "reference"), ("index.html", "content"), ("index.md", "reference"), ("docs_index.md", "reference"), ("docs_index.html", "content"), ("toc.xyz", "reference"), ("relations.pdf", "reference"), ("readme", "reference"), ("notes.md", "content"), ("manifest.pdf", "content")])
def test_doc_class(spark, name, kind):
    assert values(spark, [f"/a/{name}"], T.doc_class) == [kind]


def test_cosine_and_hash(spark):
    df = spark.createDataFrame([([1.0, 1.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    out = [r.v for r in df.select(cosine(F.col("a"), F.col("b")).alias("v")).collect()]
    assert abs(out[0] - 0.70710678) < 1e-7 and out[1:] == [0.0, 0.0, 0.0]

    def bucket(token):
        h = 1469598103934665603
        for b in token.encode():
            h = ((h ^ b) * 1099511628211) % (1 << 64)
        return h % 384

    texts = ["one two two Éa", ""]
    for text, v, same in zip(texts, values(spark, texts, hash_embedding), values(spark, texts, embed_text)):
        assert all(abs(a - b) < 1e-12 for a, b in zip(v, same))
        want = [0.0] * 384
        for t in text.split():
            want[bucket(t)] += 1
        n = sum(x * x for x in want) ** 0.5
        assert all(abs(a - (b / n if n else 0)) < 1e-12 for a, b in zip(v, want))


CASES = [  # bm25, vec, graph, entity, centrality, class, signal, score
    (1, 1, 1, 1, 0, "content", "content", 1.0),
    (1, 0, 0, 0, 0, "content", "content", 0.35),
    (1, 1, 0, 0, 0, "content", "content", 0.75),
    (1, 1, 0, 0, 0, "reference", "content", 0.45),
    (1, 1, 0, 1, 0, "content", "anchor_list", 0.2125),
    (0, 0, 0, 0, 1, "content", "content", 0.0),
    (0.5, 0, 0, 0, 1, "content", "content", 0.225),
    (0, 0.9, 1, 0, 0, "content", "content", 0.36),
]


def test_final_score(spark):
    df = spark.createDataFrame([tuple(map(float, c[:5])) + c[5:] for c in CASES], "score_bm25 double, score_vec double, score_graph double, score_entity double, score_centrality double, doc_class string, chunk_signal string, want double")
    for r in df.withColumn("got", S.final_score()).collect():
        assert abs(r.got - r.want) < 1e-9


def test_semantic_edges(spark):
    rows = [("a1", "a", 1, [1.0, 0.0]), ("a2", "a", 1, [0.9, 0.1]), ("b1", "b", 2, [0.7, 0.7]), ("c1", "c", 3, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "chunk_id string, doc_id string, arrival long, embedding array<double>")
    assert [(r.src_chunk, r.dst_chunk, r.reason) for r in E.semantic_within(v).collect()] == [("a1", "a2", "cos:0.99")]
    across = {(r.src_chunk, r.dst_chunk): r.edge_type for r in E.semantic_across(v).collect()}
    assert across == {("a1", "b1"): "semantic", ("a2", "b1"): "semantic"}


def test_status_and_index(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.86, 0.45), (0.75, 0.35), (0.6, 0.2), (0.59, 0.9)], "r double, p double")
    assert [x.s for x in df.select(V.status(F.col("r"), F.col("p")).alias("s")).collect()] == ["critical_fail", "strong_pass", "pass", "weak_pass", "fail"]
    one = spark.range(1).select(V.quality_index(F.lit(0.9), F.lit(50.0)).alias("a"), V.nearest_rank(F.array(*map(F.lit, [10, 20, 30, 40, 50])), 50).alias("p50"), V.nearest_rank(F.array(*map(F.lit, [10, 20, 30, 40, 50])), 95).alias("p95")).first()
    assert (one.a, one.p50, one.p95) == (90.0, 30, 50)


def test_duplicate_hits_count_once_for_recall(spark):
    res = spark.createDataFrame([("q", k, "a.md") for k in range(1, 6)], "query_id string, rank int, filename string")
    cases = spark.createDataFrame([("q", ["a.md"], 5)], "query_id string, relevant array<string>, k int")
    r = V.metrics(res, cases).first()
    assert r.recall_at_k == 1 and r.precision_at_k == 0.2 and r.ndcg_at_10 == 1 and r.precision_at_5 == 1


def test_csv():
    assert P.csv_pages("route,driver\nR1,Ann\n , \nR2\n")[0][1] == "row 1\ncolumn_1: route\ncolumn_2: driver\n\nrow 2\nroute: R1\ndriver: Ann\n\nrow 4\nroute: R2"
    assert P.csv_pages("a,b\n")[0][1] == "row 1\ncolumn_1: a\ncolumn_2: b"


def test_json():
    lines = P.json_lines("", {"b": {"c": [{"id": 7}, None]}, "a": True, "e": {}})
    assert lines == ["a: true", "b.c[0].id: 7", "b.c[1]: null", "e: {}"]
    assert P.json_pages("{}") == [(1, "")] and P.json_pages("5") == [(1, "value: 5")]
    big = P.json_pages(json.dumps({f"key{k}": "x" * 40 for k in range(2000)}))
    assert len(big) > 1 and all(len(t.encode()) <= P.JSON_PAGE for _, t in big) and [n for n, _ in big] == list(range(1, len(big) + 1))
    assert len(P.json_pages(json.dumps({"list": ["x" * 100] * 500}))) > 1


def test_markdown():
    pages = P.markdown_pages("# Project\nIntro *text*\n\n## Setup\n- one\n- two\n### Deep\nmore\n## Use\n`run`\n")
    assert [t.split("\n")[0] for _, t in pages] == ["Project", "Project > Setup", "Project > Use"]
    assert pages[1][1] == "Project > Setup\n\none\ntwo\nDeep\nmore" and P.markdown_pages("") == [(None, "")]


def test_office_files():
    def zipped(**files):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for k, v in files.items():
                z.writestr(k.replace("__", "/"), v)
        return b.getvalue()

    w = "xmlns:w='w'"
    docx = zipped(**{"word__document.xml": f"<w:document {w}><w:body><w:p><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:tbl><w:p><w:r><w:t>no</w:t></w:r></w:p></w:tbl></w:body></w:document>"})
    assert P.docx_pages(docx) == [(None, "one\ttwo")]
    xlsx = zipped(**{"xl__workbook.xml": "<workbook xmlns:r='r'><sheets><sheet name='S' r:id='i1'/></sheets></workbook>", "xl___rels__workbook.xml.rels": "<R><Relationship Id='i1' Target='worksheets/s.xml'/></R>", "xl__sharedStrings.xml": "<sst><si><t>hi</t></si></sst>", "xl__worksheets__s.xml": "<ws><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1'><v>5</v></c></row></sheetData></ws>"})
    assert P.xlsx_pages(xlsx) == [(None, "[S]\nhi\t\t5")]
    assert P.pdf_pages(b"%PDF\nstream\nBT (Hello \\(x\\)) Tj ET\nendstream") == [(1, "Hello (x)")]
    assert P.media_pages("a.png", "image", "seen")[0] == (1, "Image OCR text for a.png:\nseen") and P.media_pages("a.mp3", "audio", None) == [(None, "")]
