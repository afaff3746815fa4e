"""The facade: index folders, search them, walk their graph and pack context, workdir by workdir."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import embed_text
from ..operators import edges as E
from ..operators.chunking import chunk_pages
from ..operators.entities import extract_entities
from ..operators.graph import edges_among, neighborhood, neighbors, node_rows, overview
from ..operators.lexical import postings
from ..operators.pack import context_packs
from ..operators.search import hybrid_search
from ..sources.parse import list_files, parse_files, sidecars, with_sidecars
from . import lifecycle as L
from .shipping import ship
from .staging import scratch, staged
from .workspace import AlreadyIndexing, ConcurrentChange, Workspace, list_workdirs

__all__ = ["AlreadyIndexing", "ConcurrentChange", "Engine"]


class Engine:
    """embed: a text column to a vector column; by default the deterministic hash embedding. embed_query: the same for

    queries, for models that tell both apart (functions.vectors.model_embedding); by default embed. A new embed_version
    empties what was derived with another one. hooks: readers of images, films and recordings.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Callable = embed_text, embed_version: str = "hash-384", hooks: dict | None = None, graph_search: bool = False, embed_query: Callable | None = None):
        self.spark, self.root, self.embed, self.version, self.hooks, self.graph_search = spark, root, embed, embed_version, hooks, graph_search
        self.embed_query = embed_query or embed
        ship(spark)

    def workspace(self, workdir: str) -> Workspace:
        return Workspace(self.spark, self.root, workdir)

    def list_workdirs(self) -> list[str]:
        return list_workdirs(self.spark, self.root)

    def register_workdir(self, workdir: str) -> str:
        if workdir not in self.list_workdirs():
            self.workspace(workdir).reset()
        return L.workdir_id(workdir)

    def delete_workdir(self, workdir: str) -> None:
        self.workspace(workdir).delete()

    def reset_index(self, workdir: str) -> None:
        self.workspace(workdir).reset()

    def cancel_indexing(self) -> None:
        """Stops the jobs of indexing: what was published stays, the rest doesn't count."""
        self.spark.sparkContext.cancelJobGroup("bracken-index")

    def get_settings(self, workdir: str) -> dict[str, str]:
        return self.workspace(workdir).settings()

    def set_settings(self, workdir: str, **values: str) -> None:
        self.workspace(workdir).set_settings(values)

    def index_folder(self, workdir: str, folder: str) -> dict[str, int]:
        """Indexes new and changed files; returns how many were indexed, skipped and failed."""
        return self.index_files(workdir, list_files(self.spark, folder), sidecars(self.spark, folder))

    def index_file(self, workdir: str, path: str) -> dict[str, int]:
        return self.index_files(workdir, list_files(self.spark, path), sidecars(self.spark, path.rsplit("/", 1)[0]))

    def index_files(self, workdir: str, files: DataFrame, sides: DataFrame) -> dict[str, int]:
        """files as of list_files. One writer at a time: another one is refused with AlreadyIndexing."""
        ws, context = self.workspace(workdir), self.spark.sparkContext
        with ws.locked(), scratch(self.spark):
            context.setJobGroup("bracken-index", f"index {workdir}", True)
            try:
                return self._index(ws, files, sides)
            finally:
                context.setLocalProperty("spark.jobGroup.id", None)

    def _index(self, ws: Workspace, files: DataFrame, sides: DataFrame) -> dict[str, int]:
        """Reads, cuts, embeds and links new and changed files only, and publishes them with what they replace in one version.

        A file whose parse fails keeps what was indexed before; only its document row changes, which hides it.
        """
        state = self._of_this_embedding(ws)
        known = ws.table("documents", state)
        new = L.changed_files(files, known)
        parsed = parse_files(with_sidecars(new, sides), self.hooks, ("filename", "format", "doc_class", "size_bytes", "hash"))
        ids = parsed.join(known.select("path", F.col("doc_id").alias("_old")), "path", "left").withColumn("doc_id", F.coalesce("_old", F.substring(F.sha2("path", 256), 1, 20)))
        docs = staged(ids.withColumn("status", F.when(F.col("error_msg").isNull(), "indexed").otherwise("error")).withColumn("indexed_at", F.current_timestamp()), "parsed")
        seen = {r.status: r.n for r in docs.groupBy("status").agg(F.count("*").alias("n")).collect()}
        done, failed = seen.get("indexed", 0), seen.get("error", 0)
        out = {"indexed": done, "skipped": files.select("path").count() - done - failed, "failed": failed}
        if not seen:
            return out
        good = docs.where("status = 'indexed'")
        gone = docs.where("_old is not null").select("doc_id", (F.col("status") == "indexed").alias("derived"))

        def after(new: dict[str, DataFrame]) -> dict[str, DataFrame]:
            """What counts once this is published: the old rows but those of replaced documents, and the new ones."""
            replaced = {"documents": docs, "chunks": good, "entities": good, "vectors": good}
            return {n: ws.table(n, state).join(r.select("doc_id"), "doc_id", "left_anti").unionByName(new[n]) for n, r in replaced.items()}

        ws.commit(
            state,
            {
                "chunks": lambda own: chunk_pages(good.select("doc_id", "pages")),
                "entities": lambda own: extract_entities(own["chunks"]),
                "vectors": lambda own: own["chunks"].select("chunk_id", "doc_id", self.embed(F.col("content")).alias("embedding")),
                "postings": lambda own: postings(own["chunks"]),
                "documents": lambda own: self._with_counts(docs, own["chunks"], own["postings"]),
                "edges": lambda own: self.build_edges(after(own), good.select("doc_id")),
            },
            gone,
            embedding=self.version,
        )
        ws.vacuum()
        return out

    def _of_this_embedding(self, ws: Workspace) -> dict:
        """The newest version; if it was made with another embedding, one after it in which all documents wait to be indexed again."""
        state = ws.state()
        if state["embedding"] in (None, self.version):
            return state
        tables = ws.tables(state)
        settings = self.spark.createDataFrame([("embedding", state["embedding"])], L.SCHEMAS["settings"])
        waiting = L.invalidate(tables | {"settings": settings}, {"embedding": self.version})["documents"]
        return ws.publish(state, tables={"documents": [ws.write("documents", state["number"] + 1, waiting)]}, embedding=self.version, chunks=0, terms=0)

    @staticmethod
    def _with_counts(docs: DataFrame, chunks: DataFrame, posts: DataFrame) -> DataFrame:
        lengths = posts.groupBy("doc_id", "chunk_id").agg(F.first("dl").cast("long").alias("dl")).groupBy("doc_id").agg(F.sum("dl").alias("n_terms"))
        n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
        return docs.join(n, "doc_id", "left").join(lengths, "doc_id", "left").fillna(0, ["n_chunks", "n_terms"])

    @staticmethod
    def build_edges(tables: dict[str, DataFrame], new: DataFrame | None = None) -> DataFrame:
        """new (doc_id): the edges of these documents, which have arrived last, to one another and to all before; by default of all."""
        docs = staged(E.arrivals(tables["documents"].where("status = 'indexed'").select("doc_id", "doc_class", "indexed_at"), "indexed_at", "doc_id").select("doc_id", "doc_class", "arrival"), "arrived")
        content = tables["chunks"].where("chunk_signal = 'content'")
        vectors = tables["vectors"].join(content.select("chunk_id"), "chunk_id", "left_semi").join(docs.select("doc_id", "arrival"), "doc_id")
        mine = lambda df: df if new is None else staged(df.join(new, "doc_id", "left_semi"), "mine")
        own = mine(vectors)
        linked = [E.shared_anchor, E.shared_entity, E.manifest_overlap]
        semantic = E.merge_edges(E.same_doc(mine(content)), E.semantic_within(own), E.semantic_across(own, None if new is None else vectors))
        return E.merge_edges(semantic, *[f(tables["entities"], tables["chunks"], docs, new) for f in linked])

    def remove_document(self, workdir: str, doc_id: str) -> None:
        ws = self.workspace(workdir)
        with ws.locked():
            ws.commit(ws.state(), {}, self.spark.createDataFrame([(doc_id, True)], "doc_id string, derived boolean"))
            ws.vacuum()

    def _queries(self, texts: list[str]) -> DataFrame:
        q = self.spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "query_id string, text string")
        return q.withColumn("embedding", self.embed_query(F.col("text")))

    def search(self, workdir: str, text: str | list[str], limit: int = 10, depth: int = 1) -> DataFrame:
        """Ranked results of one query or many, in one job; query_id is the place in the list."""
        ws = self.workspace(workdir)
        state = ws.state()
        t, many = ws.tables(state), [text] if isinstance(text, str) else text
        return hybrid_search(self._queries(many), t["documents"], t["chunks"], t["entities"], t["vectors"], t["postings"], ws.counts(state), t["edges"] if self.graph_search else None, min(limit, 50), depth)

    def context_pack(self, workdir: str, text: str, budget: int = 6000, limit: int = 10, depth: int = 1, include_graph: bool = True) -> DataFrame:
        t = self.workspace(workdir).tables()
        return context_packs(self._queries([text]), self.search(workdir, text, limit, depth), t["edges"], t["chunks"], t["documents"], min(budget, 200_000), limit, depth, include_graph)

    def get_index_stats(self, workdir: str) -> DataFrame:
        return L.stats(self.workspace(workdir).tables())

    def list_documents(self, workdir: str) -> DataFrame:
        return self.workspace(workdir).table("documents").orderBy(F.desc("indexed_at"), "filename")

    def find_documents(self, workdir: str, part: str) -> DataFrame:
        """Documents whose filename holds `part`."""
        return L.named_like(self.workspace(workdir).table("documents"), part)

    def get_doc_chunks(self, workdir: str, doc_id: str) -> DataFrame:
        return L.chunks_of(self.workspace(workdir).table("chunks"), doc_id)

    def get_chunk_neighbors(self, workdir: str, chunk_id: str, depth: int = 1) -> DataFrame:
        """depth only multiplies how many rows come; it is no number of steps."""
        t = self.workspace(workdir).tables()
        one = self.spark.createDataFrame([(chunk_id,)], "chunk_id string")
        return neighbors(one, t["edges"], t["chunks"], t["documents"], depth * 50)

    def get_graph_overview(self, workdir: str, limit: int = 250) -> tuple[DataFrame, DataFrame]:
        t = self.workspace(workdir).tables()
        return overview(t["edges"], t["chunks"], t["documents"], min(limit, 1000))

    def get_graph_neighborhood(self, workdir: str, chunk_id: str, depth: int = 2, limit: int = 160) -> tuple[DataFrame, DataFrame]:
        return self.get_search_neighborhood(workdir, [chunk_id], min(max(depth, 1), 4), limit)

    def get_search_neighborhood(self, workdir: str, chunk_ids: list[str], depth: int = 1, limit: int = 200) -> tuple[DataFrame, DataFrame]:
        t = self.workspace(workdir).tables()
        seeds = self.spark.createDataFrame([(c,) for c in chunk_ids], "chunk_id string")
        nodes = node_rows(neighborhood(seeds, t["edges"], min(depth, 4), limit), t["edges"], t["chunks"], t["documents"])
        return nodes.orderBy("depth", F.desc("degree"), "chunk_id"), edges_among(nodes, t["edges"])
