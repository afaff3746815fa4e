"""Workspaces that are derived from tables: prose (documents) and trade (orders of each customer, with anchors and dates)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import doc_class, format_of
from ..functions.vectors import embed_text
from ..operators import edges as E
from ..operators.chunking import chunk_texts
from ..operators.entities import extract_entities
from ..operators.lexical import postings, stats_of_postings
from ..operators.search import hidden_documents, indexed_chunks
from .staging import staged

#: Literal queries of the trade corpus: (query_id, text).
TRADE_QUERIES = (
    ("q1", "Priority Handling for AUTOMOBILE goods"),
    ("q2", "ORD-15-F"),
    ("q3", "Customer#000000010 orders shipped"),
    ("q4", "holds shipped orders listing"),
    ("q5", "shipped on 03/10/1998"),
    ("q6", "NAT-3-ASIA"),
    ("q7", "the requested segment (goods): ASIA?"),
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def literal_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TRADE_QUERIES), "query_id string, text string")


class Corpus:
    """documents (doc_id, filename, path, format, doc_class, status, text) and what is derived from them.

    The derived tables are the index: each is written once, when it is first asked for.
    """

    def __init__(self, documents: DataFrame):
        with_path = documents.withColumn("path", F.concat(F.lit("/corpus/"), "filename"))
        self.documents = with_path.withColumns({"doc_class": doc_class(F.col("path")), "format": format_of(F.col("path"))})

    @cached_property
    def chunks(self) -> DataFrame:
        return staged(chunk_texts(self.documents.select("doc_id", "text")), "chunks")

    @cached_property
    def entities(self) -> DataFrame:
        return staged(extract_entities(self.chunks), "entities")

    @cached_property
    def arrived(self) -> DataFrame:
        return staged(E.arrivals(self.documents.select("doc_id", "doc_class"), "doc_id"), "arrivals")

    @cached_property
    def told(self) -> DataFrame:
        """The entities of content chunks with the arrival and class of their documents: all families read them, some four times."""
        return staged(E.content_entities(self.entities, self.chunks, self.arrived, None), "told")

    def edge_families(self) -> dict[str, DataFrame]:
        return {
            "same_doc": E.same_doc(self.chunks),
            "shared_anchor": E.shared_anchor(self.told, self.chunks, self.arrived),
            "shared_entity": E.shared_entity(self.told, self.chunks, self.arrived),
            "manifest_overlap": E.manifest_overlap(self.told, self.chunks, self.arrived),
        }

    @cached_property
    def links(self) -> DataFrame:
        """The edges between documents."""
        families = self.edge_families()
        return staged(E.merge_edges(*[f for name, f in families.items() if name != "same_doc"]), "links")

    @cached_property
    def edges(self) -> DataFrame:
        """The links, and all pairs inside a document.

        These are different pairs, so nothing is merged; and as they grow with the square of a document's length, they
        are not written but made by whoever reads them, who often wants them counted or not at all.
        """
        return self.links.unionByName(E.same_doc(self.chunks))

    def edges_at(self, nodes: DataFrame) -> DataFrame:
        """Those of the edges that touch the nodes (chunk_id), a few chunks: made without the others.

        An edge between documents stands on a value that both its ends hold. All rows of the nodes' values are read,
        so that who comes first and how many hold a value is counted as it is for all edges.
        """
        nodes = staged(nodes.select("chunk_id").distinct(), "nodes")
        near = staged(E.with_values_of(self.told, nodes), "near")
        families = (f(near, self.chunks, self.arrived) for f in (E.shared_anchor, E.shared_entity, E.manifest_overlap))
        return E.merge_edges(*[E.touching(f, nodes) for f in families]).unionByName(E.same_doc(self.chunks, nodes))

    @cached_property
    def visible(self) -> DataFrame:
        return staged(indexed_chunks(self.chunks, self.documents), "visible")

    @cached_property
    def hidden(self) -> DataFrame:
        return staged(hidden_documents(self.documents), "hidden")

    @cached_property
    def vectors(self) -> DataFrame:
        return staged(self.chunks.select("chunk_id", "doc_id", embed_text(F.col("content")).alias("embedding")), "vectors")

    @cached_property
    def postings(self) -> DataFrame:
        """Of all chunks, hidden ones included."""
        return staged(postings(self.chunks), "postings")

    @cached_property
    def stats(self) -> DataFrame:
        """Of the visible chunks: one row, made when the index is."""
        return staged(stats_of_postings(self.postings, self.visible), "stats")


#: Indexes of this session's runs, by corpus and input.
_OPEN: dict[tuple[str, str, str], Corpus] = {}


def _opened(kind: str, spark: SparkSession, sf_dir: str, documents) -> Corpus:
    key = (kind, spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        docs, cores = documents(spark, sf_dir), spark.sparkContext.defaultParallelism
        # A table in a few files would be cut and read by as few tasks; one in many needs no exchange.
        if read(spark, sf_dir, "documents" if kind == "prose" else "orders").rdd.getNumPartitions() < cores:
            docs = docs.repartition(cores)
        _OPEN[key] = Corpus(staged(docs, f"{kind}-docs"))
    return _OPEN[key]


def prose(spark: SparkSession, sf_dir: str) -> Corpus:
    return _opened("prose", spark, sf_dir, _prose)


def trade(spark: SparkSession, sf_dir: str) -> Corpus:
    return _opened("trade", spark, sf_dir, _trade)


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; those with a bad quality label count as failed."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    own = docs.join(labels, "doc_id", "left")
    return own.select(F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("doc_id"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.when(F.col("quality") == 0, "error").otherwise("indexed").alias("status"), "text")


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document of orders for each customer, a listing of customer files for each nation, anchor lists and title cards for each region."""
    c, o, n, r = (read(spark, sf_dir, t) for t in ("customer", "orders", "nation", "region"))
    if o.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        o = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").repartition(spark.sparkContext.defaultParallelism)
    places = n.join(r, n["n_regionkey"] == r["r_regionkey"]).withColumn("nat", F.concat(F.lit("NAT-"), F.col("n_nationkey").cast("string"), F.lit("-"), F.replace("r_name", F.lit(" "), F.lit(""))))
    who = c.join(places, c["c_nationkey"] == places["n_nationkey"])
    rows = o.join(who, o["o_custkey"] == who["c_custkey"])
    line = F.concat(
        F.lit("Order ORD-"), F.col("o_orderkey").cast("string"), F.lit("-"), "o_orderstatus", F.lit(" by "), "c_name", F.lit(" shipped on "), F.date_format("o_orderdate", "dd/MM/yyyy"),
        F.lit(" under "), "nat", F.lit(". Priority Handling was requested for the "), "c_mktsegment", F.lit(" Segment goods."),
    )
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda x: x["line"]), "\n")
    status = F.when(F.first("c_acctbal") < 0, "error").otherwise("indexed")
    customers = rows.groupBy("c_custkey").agg(lines.alias("text"), status.alias("status"))
    customers = customers.select(F.concat(F.lit("cust-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("doc_id"), F.concat(F.lit("cust_"), F.col("c_custkey").cast("string"), F.lit(".txt")).alias("filename"), "status", "text")
    buyers = rows.select("n_nationkey", "n_name", "nat", "c_custkey").distinct()
    files = F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda k: F.concat(F.lit("cust_"), k.cast("string"), F.lit(".txt holds shipped orders."))), " ")
    nations = buyers.groupBy("n_nationkey", "n_name", "nat").agg(files.alias("files"))
    nations = nations.select(F.concat(F.lit("nation-"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("doc_id"), F.concat(F.lit("README-"), "n_name", F.lit(".md")).alias("filename"), F.lit("indexed").alias("status"), F.concat(F.lit("Nation listing of "), "nat", F.lit(" with customer files. "), "files").alias("text"))
    anchors = places.groupBy("r_regionkey", "r_name").agg(F.array_join(F.sort_array(F.collect_list("nat")), " ").alias("nats"))
    regions = anchors.select(F.concat(F.lit("region-"), F.col("r_regionkey").cast("string")).alias("doc_id"), F.concat(F.lit("region_"), F.col("r_regionkey").cast("string"), F.lit(".txt")).alias("filename"), F.lit("indexed").alias("status"), F.concat(F.lit("Related anchors: "), "nats").alias("text"))
    cards = anchors.select(F.concat(F.lit("title-"), F.col("r_regionkey").cast("string")).alias("doc_id"), F.concat(F.lit("title_"), F.col("r_regionkey").cast("string"), F.lit(".md")).alias("filename"), F.lit("indexed").alias("status"), F.concat(F.lit("title: Region card tags: trade company: "), "r_name", F.lit(" anchors: "), "nats").alias("text"))
    listed = F.concat(F.lit("Every nation of the region "), "r_name", F.lit(" has a listing of its customer files, see there: "), "nats", F.lit("."))
    indexes = anchors.select(F.concat(F.lit("zindex-"), F.col("r_regionkey").cast("string")).alias("doc_id"), F.concat(F.lit("region"), F.col("r_regionkey").cast("string"), F.lit("_index.md")).alias("filename"), F.lit("indexed").alias("status"), listed.alias("text"))
    return customers.unionByName(nations).unionByName(regions).unionByName(cards).unionByName(indexes)
