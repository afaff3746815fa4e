"""From raw documents to packed training sequences, in five stages over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bracken.llm.common import read, staged
from bracken.llm.language_id import is_held_out, label_languages, train
from bracken.llm.line_runs import dedup_lines
from bracken.llm.minhash_dedup import near_duplicates
from bracken.llm.packing import pack, token_pieces, tokenizer_path
from bracken.llm.source_mixing import emit_copies, mix_sources


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go; where no row names a language to learn, those without a letter."""
    model = train(docs.where(~is_held_out()))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    labelled = label_languages(docs.select(F.struct("*").alias("row"), F.col("text").alias("text")), model)
    return labelled.where("lang_pred <> 'und'").select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; every document stays, also one that is left empty."""
    cleaned = dedup_lines(docs.select(F.struct("*").alias("row"), "doc_id", "text"), min_docs=10)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    chars = F.when(F.col("n_dropped") > 0, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    return cleaned.select(F.col("row").withField("text", text).withField("n_chars", chars).alias("row")).select("row.*")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that with the smallest doc_id, rows without an id last.

    Where ids repeat or are missing, rows get keys of their own; of rows of equal ids that with the smallest hash stays.
    Texts without a word are in no group and stay.
    """
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_kept"))
        return docs.join(kept, docs["doc_id"] == kept["_kept"], "left_semi")
    keyed = staged(docs.withColumn("_key", F.monotonically_increasing_id()), "near-keyed")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(F.to_json(F.struct(*docs.columns))), "_key")
    places = keyed.select("_key", place.alias("place"))
    first = near_duplicates(keyed, id_col="_key").join(places, "_key").groupBy("component_id").agg(F.min("place")["_key"].alias("_key"))
    return keyed.join(first, "_key", "left_semi").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights take it."""
    return emit_copies(mix_sources(docs, keep=True))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: where each piece of each document stands in the sequences."""
    out = pack(token_pieces(docs, tokenizer_path()))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("language", language_stage), ("lines", line_stage), ("near_duplicates", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Language models, seeded draws, tokenizers and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
