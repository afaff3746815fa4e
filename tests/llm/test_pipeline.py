"""The pipeline's stages, each held to what it says it does."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from bracken.llm.minhash_dedup import near_duplicates
from bracken.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12 34 56", None, "src1", 8), (10**6 + 1, None, None, None, 0)], docs.schema)
    start = docs.unionByName(extra).cache()
    assert [n for n, _ in pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixing", "packing"]
    spoken = pipeline.language_stage(spark, start, SF).cache()
    assert spoken.columns == docs.columns and {r.doc_id for r in spoken.collect()} == {r.doc_id for r in docs.collect()}
    lined = pipeline.line_stage(spark, spoken, SF).cache()
    shared = lined.select("doc_id", F.explode(F.split("text", "\n")).alias("x")).where("trim(x) <> ''").groupBy(F.lower(F.trim("x"))).agg(F.countDistinct("doc_id").alias("n"))
    assert lined.columns == docs.columns and shared.where("n >= 10").count() == 0 and lined.count() >= 0.95 * spoken.count()
    near = pipeline.near_stage(spark, lined, SF).cache()
    assert near.columns == docs.columns and near.count() < lined.count() and near_duplicates(near).where("not kept").count() == 0
    mixed = pipeline.mixing_stage(spark, near, SF).cache()
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    packed = pipeline.packing_stage(spark, mixed, SF)
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("a"), F.max(F.col("offset") + F.col("length")).alias("b"))
    assert packed.where("piece = 0").count() == mixed.count() and ends.where("a <> b or a > 4096").count() == 0


def test_near_stage_with_repeated_and_missing_ids(spark):
    one, two = " ".join(f"w{k}" for k in range(60)), " ".join(f"v{k}" for k in range(60))
    rows = [(1, one), (1, one), (1, two), (2, two), (3, one + " end"), (None, one), (None, "a b c d e f"), (None, "a b c d e f"), (4, two), (5, ""), (5, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_stage(spark, docs, SF)
    want = [(1, one), (1, two), (5, ""), (5, ""), (None, "a b c d e f")]
    assert kept.columns == docs.columns and sorted(map(str, want)) == sorted(str((r.doc_id, r.text)) for r in kept.collect())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None, None, 9), (2, "1 2", None, None, 3), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in pipeline.language_stage(spark, docs, SF).collect()] == [1]
    for _, stage in pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).count() >= 3 and stage(spark, docs.limit(0), SF).count() == 0


def test_registered():
    assert sorted(n.split("_")[0] for n in queries()) == sorted(f"op{k}" for k in range(1, 11))
    assert set(oracle_sql()) <= set(queries())
