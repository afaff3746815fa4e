"""Hybrid ranking. Candidates are rows keyed by (query_id, chunk_id), so one job answers many queries.

queries: (query_id, text[, embedding]). Workspace tables: documents (doc_id, filename, doc_class, status), chunks,
entities, vectors (chunk_id, embedding[, doc_id]), postings, edges. No search copies a table: what is visible is a
condition on each, and what a query needs of the corpus as a whole (BM25's counts) is stored with the index.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, contains_phrase, entity_terms, normalize_entity, routing_terms
from ..plans.staging import staged
from .edges import endpoints, strongest
from .lexical import best, bm25

#: Fixed values of the score.
W_VEC, W_BM25, W_GRAPH, W_ENTITY, W_CENTRALITY, GATE = 0.40, 0.35, 0.15, 0.10, 0.05, 0.20
REFERENCE_FACTOR, LOW_SIGNAL_FACTOR = 0.6, 0.25
PER_DOC, ROUTED, FANOUT, STRONG, SEEDS = 10, 6, 3, 0.62, 10
EXPANDABLE = ["semantic", "shared_anchor", "shared_entity", "manifest_overlap"]
PARTS = ("score_vec", "score_bm25", "score_entity", "score_graph", "score_centrality")
#: Queries of one product with a batch of vectors, and numbers of query vectors that one scan carries along (256 MB).
QUERY_BLOCK, SCAN_NUMBERS = 1024, 1 << 25
#: Scores of entities that a task remembers, and pairs of entity rows and queries that it lays out at once.
REMEMBERED, PAIRS = 1 << 18, 1 << 20
#: Vectors that a block of queries is multiplied with at once.
VECTORS = 2048


def max_normalized(df: DataFrame, score: str = "score", by: str = "query_id") -> DataFrame:
    """Scores over the largest of their query, in [0, 1]; all 0 if none is above 0."""
    top = F.max(score).over(W.partitionBy(by))
    return df.withColumn(score, F.when(top > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score) / top))).otherwise(0.0))


def is_low_signal(signal: str | Column = "chunk_signal") -> Column:
    return F.coalesce((F.col(signal) if isinstance(signal, str) else signal).isin("anchor_list", "metadata"), F.lit(False))


def final_score() -> Column:
    """From the columns PARTS, doc_class and chunk_signal."""
    vec, lex, ent, graph, central = map(F.col, PARTS)
    low = F.when(is_low_signal(), LOW_SIGNAL_FACTOR).otherwise(1.0)
    text = (W_VEC * vec + W_BM25 * lex) * F.when(F.col("doc_class") == "reference", REFERENCE_FACTOR).otherwise(1.0) * low
    linked = F.when(F.greatest(lex, ent) >= GATE, W_GRAPH * graph).otherwise(0.0)
    tie = F.when(F.greatest(vec, lex, ent) >= GATE, W_CENTRALITY * central).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), text + linked + W_ENTITY * ent * low + tie))


def indexed_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of the documents that are visible, with their class and filename."""
    docs = documents.where("status = 'indexed'").select("doc_id", "filename", "doc_class")
    return chunks.join(docs, "doc_id")


def hidden_documents(documents: DataFrame) -> DataFrame:
    return documents.where("status is null or status <> 'indexed'").select("doc_id")


def only_visible(rows: DataFrame, hidden: DataFrame, visible: DataFrame) -> DataFrame:
    """Rows of visible documents. By doc_id where there is one: hidden documents are few, and an anti-join with few rows moves nothing."""
    if "doc_id" in rows.columns:
        return rows.join(hidden, "doc_id", "left_anti")
    return rows.join(visible.select("chunk_id"), "chunk_id", "left_semi")


class _Best:
    """The k best rows so far of each query of a block: largest cosine, rounded to nine places, then the smaller id."""

    def __init__(self, ids: list[str], q: np.ndarray, k: int):
        self.ids, self.k = np.array(ids, object), k
        norm = np.sqrt((q * q).sum(axis=1, keepdims=True))
        self.q = np.divide(q, norm, out=np.zeros_like(q), where=norm > 0)
        self.rows = pd.DataFrame({"i": np.empty(0, np.int64), "chunk_id": np.empty(0, object), "score": np.empty(0)})

    def add(self, unit: np.ndarray, keys: np.ndarray) -> None:
        """keys: in order, so that of equal rows those with smaller ids come first. VECTORS rows at once bound the product."""
        for at in range(0, len(keys), VECTORS):
            self._add(unit[at : at + VECTORS], keys[at : at + VECTORS])

    def _add(self, unit: np.ndarray, keys: np.ndarray) -> None:
        sims = np.clip(self.q @ unit.T, 0, 1)
        near = np.round(sims, 9)
        if len(keys) > self.k:
            may = near >= np.partition(near, -self.k, axis=1)[:, -self.k, None]
            alike = may.sum(axis=1) > 4 * self.k  # as where nothing is near and all are 0
            may[alike] = False
            for row in np.flatnonzero(alike):
                may[row, np.argsort(-near[row], kind="stable")[: self.k]] = True
            i, j = np.nonzero(may)
        else:
            i, j = (x.ravel() for x in np.indices(sims.shape))
        rows = pd.concat([self.rows, pd.DataFrame({"i": i, "chunk_id": keys[j], "score": sims[i, j]})])
        rows = rows.assign(minus=-rows["score"].round(9)).sort_values(["i", "minus", "chunk_id"]).drop(columns="minus")
        self.rows = rows[rows.groupby("i").cumcount() < self.k]

    def found(self) -> pd.DataFrame:
        return pd.DataFrame({"query_id": self.ids[self.rows["i"].to_numpy(np.int64)], "chunk_id": self.rows["chunk_id"], "score": self.rows["score"]})


def vector_candidates(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score): the k nearest vectors by cosine; negative values count as 0, ties go to the smaller id.

    The query vectors travel to the scan, in blocks; vectors don't move. One scan carries SCAN_NUMBERS numbers of
    query vectors (65,536 queries of 512 dimensions), more queries take more scans. A scan task keeps k rows a query
    over all its batches, so at most those are shuffled. Vectors of other lengths, and null ones, are not found.
    """
    asked = queries.where("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = vectors.where("embedding is not null").select("chunk_id", F.col("embedding").cast("array<double>").alias("embedding"))
    scans: list[list[tuple[list[str], np.ndarray]]] = []
    by_width: dict[int, list] = {}
    room = 0

    def close(own: list) -> None:
        nonlocal room
        q = np.array([r.embedding for r in own], float)
        if not scans or room < q.size:
            scans.append([])
            room = SCAN_NUMBERS
        room -= q.size
        scans[-1].append(([r.query_id for r in own], q))

    for r in asked.toLocalIterator():
        own = by_width.setdefault(len(r.embedding), [])
        own.append(r)
        if len(own) == QUERY_BLOCK:
            close(by_width.pop(len(r.embedding)))
    for own in by_width.values():
        close(own)

    def scan(blocks):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = [_Best(ids, q, k) for ids, q in blocks.value]
            for pdf in batches:
                width = pdf["embedding"].map(len)
                for n in {b.q.shape[1] for b in best} & set(width):
                    same = pdf[width == n].sort_values("chunk_id")
                    x, keys = np.stack(same["embedding"].to_numpy()), same["chunk_id"].to_numpy()
                    length = np.sqrt((x * x).sum(axis=1, keepdims=True))
                    unit = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
                    for b in best:
                        if b.q.shape[1] == n:
                            b.add(unit, keys)
            for b in best:
                yield b.found()

        return run

    context = rows.sparkSession.sparkContext
    found = [rows.mapInPandas(scan(context.broadcast(blocks)), "query_id string, chunk_id string, score double") for blocks in scans]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id string, chunk_id string, score double")
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def entity_match(query_norm: Column, query_terms: Column, entity: Column) -> Column:
    terms = entity_terms(entity)
    overlap = F.size(F.array_intersect(terms, query_terms))
    return (
        F.when(entity == "", 0.0)
        .when(entity == query_norm, 3.0)
        .when(contains_phrase(query_norm, entity), 2.5)
        .when((F.octet_length(query_norm) >= 4) & contains_phrase(entity, query_norm), 2.0)
        .when(overlap > 0, 0.4 + 0.8 * overlap / F.size(terms))
        .otherwise(0.0)
    )


class EntityScorer:
    """entity_match of a normalised value with many queries: (queries' places, scores) of those above 0.

    A value is scored with the queries that share a word with it. What is known of values is kept, up to REMEMBERED scores.
    """

    def __init__(self, asked: list):
        self.asked = [(r.qn, f" {r.qn} ", frozenset(r.qt), len(r.qn.encode()) >= 4) for r in asked]
        self.by_word: dict[str, list[int]] = {}
        for k, r in enumerate(asked):
            for w in r.qw:
                self.by_word.setdefault(w, []).append(k)
        self.words = re.compile(r"[^ \t\n\x0b\f\r]+").findall  # what Java's \s leaves
        self.known: dict[str, tuple[list[int], list[float]]] = {}
        self.kept = 0

    def __call__(self, value: str) -> tuple[list[int], list[float]]:
        own = dict.fromkeys(self.words(value))
        near = sorted({k for w in own if w in self.by_word for k in self.by_word[w]})
        places, scores = [], []
        if near:
            terms, phrase = [w for w in own if len(w.encode()) >= 2], f" {value} "
            for k in near:
                qn, asked, qt, long = self.asked[k]
                if value == qn:
                    m = 3.0
                elif phrase in asked:
                    m = 2.5
                elif long and asked in phrase:
                    m = 2.0
                else:
                    overlap = sum(t in qt for t in terms)
                    m = 0.4 + 0.8 * overlap / len(terms) if overlap else 0.0
                if m > 0:
                    places.append(k)
                    scores.append(m)
        if self.kept >= REMEMBERED:
            self.known.clear()
            self.kept = 0
        self.kept += 1 + len(places)
        self.known[value] = out = (places, scores)
        return out


def _score_entities(blocks, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a query and chunk, as far as a batch holds the chunk's rows."""
    asked = blocks.value
    score, ids = EntityScorer(asked), pa.array([r.query_id for r in asked])
    for batch in batches:
        values, chunks = batch.column("en").dictionary_encode(), batch.column("chunk_id").dictionary_encode()
        told = [score.known.get(v) or score(v) for v in values.dictionary.to_pylist()]
        sizes = np.array([len(places) for places, _ in told], np.int64)
        starts = np.cumsum(sizes) - sizes
        places = np.fromiter((k for p, _ in told for k in p), np.int64)
        scores = np.fromiter((m for _, s in told for m in s), float)
        value, chunk = values.indices.to_numpy(zero_copy_only=False), chunks.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.flatnonzero(sizes[value] > 0)
        # Rows that are laid out at once, with all their queries: so many that the pairs stay few.
        part = np.cumsum(sizes[value[rows]]) // PAIRS
        for own in np.split(rows, np.flatnonzero(np.diff(part)) + 1) if len(rows) else []:
            n = sizes[value[own]]
            at = np.repeat(starts[value[own]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            keys, where = np.unique(np.repeat(chunk[own], n) * len(asked) + places[at], return_inverse=True)
            total = np.bincount(where, weights=scores[at])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keys % len(asked))), chunks.dictionary.take(pa.array(keys // len(asked))), pa.array(total)], ["query_id", "chunk_id", "score"])


def entity_candidates(queries: DataFrame, entities: DataFrame, k: int | None) -> DataFrame:
    """(query_id, chunk_id, score): entity_match summed over a chunk's entity rows, the k best, or all of them.

    An entity scores above 0 only if it shares a term with the query, or one of them is the other's phrase, which
    shares its terms too; so entities and queries meet on words. One-byte words are no terms; values and queries made
    of such words only meet on the whole value. The queries travel to the entities, which stay where they are: values
    that share a word with a query may be as many as the documents. Only sums of a query and chunk are exchanged.
    """
    words = F.array_distinct(F.filter(F.split("qn", r"\s+"), lambda t: t != ""))
    asked = queries.select("query_id", normalize_entity(F.col("text")).alias("qn")).distinct().withColumns({"qt": entity_terms(F.col("qn")), "qw": words})
    blocks = queries.sparkSession.sparkContext.broadcast(asked.where((F.col("qn") != "") & (F.size("qt") > 0)).collect())
    own = entities.where("normalized_value <> ''").select("chunk_id", F.col("normalized_value").alias("en"))
    met = own.mapInArrow(lambda batches: _score_entities(blocks, batches), "query_id string, chunk_id string, score double")
    scored = met.groupBy("query_id", "chunk_id").agg(F.sum("score").alias("score"))
    return scored if k is None else best(scored, k).drop("rank")


def pool(vec: DataFrame, lex: DataFrame, ent: DataFrame) -> DataFrame:
    """The union of the three normalised lists, one row for each query and chunk."""
    lists = [max_normalized(df.select("query_id", "chunk_id", "score")).select("query_id", "chunk_id", *[(F.col("score") if p == part else F.lit(0.0)).alias(p) for p in PARTS]) for part, df in zip(PARTS, (vec, lex, ent))]
    return reduce(DataFrame.unionByName, lists).groupBy("query_id", "chunk_id").agg(*[F.max(p).alias(p) for p in PARTS])


def has_all_terms(text: Column, terms: Column) -> Column:
    return F.forall(terms, lambda t: F.contains(text, t))


def trigrams(text: Column) -> Column:
    """The different runs of three characters that a text holds."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def _grams_held(wanted, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk_id, gram): those of the wanted trigrams that each text holds. A text is passed over once, or asked for a few."""
    grams = wanted.value
    for batch in batches:
        ids, held, counts = batch.column("chunk_id"), [], []
        for text in batch.column("ref").to_pylist():
            own = [g for g in grams if g in text] if 4 * len(grams) < len(text) else grams.intersection(map("".join, zip(text, text[1:], text[2:])))
            held += own
            counts.append(len(own))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(counts)), counts))), pa.array(held, pa.string())], ["chunk_id", "gram"])


def reference_texts(queries: DataFrame, visible: DataFrame) -> DataFrame:
    """(query_id, terms, ref): lower-case texts of reference chunks that hold all of the query's terms, as parts of words or whole.

    Terms have three characters or more, so a text that holds them holds their trigrams: texts and queries meet on the
    query's rarest one, and only where they do is a text fetched and are all terms looked for. Only ids of chunks are
    laid out by trigram, never texts.
    """
    asked = queries.select("query_id", routing_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
    refs = visible.where("doc_class = 'reference' and chunk_signal = 'content'").select("chunk_id", ascii_lower(F.col("content")).alias("ref"))
    wanted = asked.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("terms", trigrams)))).alias("gram"))
    grams = refs.sparkSession.sparkContext.broadcast({r.gram for r in wanted.select("gram").distinct().collect()})
    held = staged(refs.where("ref is not null").mapInArrow(lambda batches: _grams_held(grams, batches), "chunk_id string, gram string"), "grams")
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    # A trigram that no text holds is the rarest: such a query meets nothing.
    rare = wanted.join(F.broadcast(counts), "gram", "left").groupBy("query_id").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    near = held.join(F.broadcast(rare), "gram").join(F.broadcast(asked), "query_id").select("chunk_id", "query_id", "terms")
    met = refs.join(near, "chunk_id")
    return met.where(has_all_terms(F.col("ref"), F.col("terms"))).select("query_id", "terms", "ref")


def mentioned(texts: DataFrame, filenames: DataFrame) -> DataFrame:
    """(query_id, filename): the filenames that a query's reference texts contain.

    Names are cut out of the texts and joined by equality: wherever a dot has usual characters around it, and, for
    names with other characters (spaces, more dots, other letters), at each place in each of the lengths that such
    names have. File systems limit a name's length, so these lengths are few.
    """
    names = filenames.select("filename", ascii_lower(F.col("filename")).alias("low")).distinct()
    usual = F.col("low").rlike(r"^[a-z0-9_#-]+\.[a-z0-9]+$")
    runs = texts.select("query_id", F.explode(F.regexp_extract_all("ref", F.lit(r"[a-z0-9_#-]+\.[a-z0-9]+"), F.lit(0))).alias("run"))
    # Cut where the texts are: runs that were made distinct first are so small that all would be cut in one task.
    # A run may hold a name as a part: its suffixes before the dot and prefixes after it are the names it contains.
    stem, ext = F.regexp_extract("run", r"^(.*)\.", 1), F.regexp_extract("run", r"\.([^.]*)$", 1)
    suffixes = F.transform(F.sequence(F.lit(1), F.length(stem)), lambda i: F.substring(stem, i, F.length(stem)))
    prefixes = F.transform(F.sequence(F.lit(1), F.length(ext)), lambda i: F.substring(ext, F.lit(1), i))
    parts = runs.select("query_id", F.explode(suffixes).alias("s"), prefixes.alias("p")).select("query_id", "s", F.explode("p").alias("e"))
    cut = parts.select("query_id", F.concat_ws(".", "s", "e").alias("low"))
    odd = names.where(~usual & (F.col("low") != ""))
    lengths = sorted(r.n for r in odd.select(F.length("low").alias("n")).distinct().collect())
    if lengths:
        at = texts.select("query_id", "ref").distinct().select("query_id", "ref", F.explode(F.array(*map(F.lit, lengths))).alias("n"))
        places = F.explode(F.transform(F.sequence(F.lit(1), F.length("ref") - F.col("n") + 1), lambda i: F.substring("ref", i, F.col("n"))))
        cut = cut.unionByName(at.where(F.length("ref") >= F.col("n")).select("query_id", places.alias("low")))
    return cut.distinct().join(names, "low").select("query_id", "filename").distinct()


def first_chunks(chunks: DataFrame, n: int = ROUTED) -> DataFrame:
    """The first n of each file's chunks, with their place."""
    place = F.row_number().over(W.partitionBy("filename").orderBy("chunk_index", "chunk_id"))
    return chunks.withColumn("place", place).where(F.col("place") <= n)


def expandable(edges: DataFrame) -> DataFrame:
    """Edges that expansion follows: of the kinds that say something about content, and strong."""
    return edges.where(F.col("edge_type").isin(EXPANDABLE) & (F.col("weight") >= STRONG))


def routed(queries: DataFrame, visible: DataFrame) -> DataFrame:
    """(query_id, chunk_id): of each content file that the query's reference texts mention, those of its first chunks that hold all terms.

    The files are written, so that it is known how many there are: chunks of other files don't take part in the ranking.
    """
    content = visible.where("doc_class = 'content'")
    files = staged(mentioned(reference_texts(queries, visible), content.select("filename").distinct()), "files")
    first = first_chunks(content.where("chunk_signal = 'content'").join(files.select("filename").distinct(), "filename", "left_semi"))
    asked = queries.select("query_id", routing_terms(F.col("text")).alias("terms"))
    hits = first.join(files, "filename").join(asked, "query_id").where(has_all_terms(ascii_lower(F.col("content")), F.col("terms")))
    return hits.select("query_id", "chunk_id").distinct()


def seeds(scored: DataFrame, n: int = SEEDS) -> DataFrame:
    """The n best content rows of each query; where it has none, the n best of any."""
    has = F.max((~is_low_signal()).cast("int")).over(W.partitionBy("query_id"))
    order = W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    own = scored.withColumn("has", has).where((F.col("has") == 0) | ~is_low_signal())
    return own.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("has", "place")


def expand(seed_rows: DataFrame, edges: DataFrame, visible: DataFrame, depth: int) -> DataFrame:
    """(query_id, chunk_id, score): best product of weights along at most `depth` strong edges from the seeds, normalised."""
    content = visible.where("doc_class = 'content' and chunk_signal = 'content'").select(F.col("chunk_id").alias("other"))
    strong = strongest(expandable(edges), FANOUT, among=content).select("node", "other", "weight")
    front = seed_rows.select("query_id", "chunk_id", F.lit(1.0).alias("score"))
    start, reached = front.select("query_id", "chunk_id"), None
    for _ in range(depth):
        front = front.join(strong, front["chunk_id"] == strong["node"]).select("query_id", F.col("other").alias("chunk_id"), (F.col("score") * F.col("weight")).alias("score"))
        front = front.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")).join(start, ["query_id", "chunk_id"], "left_anti")
        reached = front if reached is None else reached.unionByName(front)
    if reached is None:
        return front.limit(0)
    return max_normalized(reached.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")))


def centrality(edges: DataFrame) -> DataFrame:
    """(chunk_id, score_centrality): the mean weight of a chunk's edges over the largest mean."""
    mean = endpoints(edges).groupBy("chunk_id").agg(F.avg("weight").alias("m"))
    top = mean.agg(F.max("m").alias("top"))  # one row
    return mean.crossJoin(F.broadcast(top)).select("chunk_id", F.when(F.col("top") > 0, F.col("m") / F.col("top")).otherwise(0.0).alias("score_centrality"))


def promoted(queries: DataFrame, rows: DataFrame, visible: DataFrame) -> DataFrame:
    """rows (candidates with score and what visible says of their chunks, but texts) with `promoted`: the best chunk of each content file that reference texts name.

    The texts are those of the query's own good reference candidates, else those of all reference chunks with its terms.
    """
    near = F.greatest("score_vec", "score_bm25", "score_entity") >= GATE
    texts = visible.where("doc_class = 'reference'").select("chunk_id", ascii_lower(F.col("content")).alias("ref"))
    own = rows.where(near & (F.col("doc_class") == "reference")).select("query_id", "chunk_id").join(texts, "chunk_id").select("query_id", "ref")
    other = reference_texts(queries, visible).select("query_id", "ref").join(own.select("query_id").distinct(), "query_id", "left_anti")
    files = mentioned(own.unionByName(other), rows.where("doc_class = 'content'").select("filename").distinct()).withColumn("told", F.lit(True))
    of_file = F.row_number().over(W.partitionBy("query_id", "filename").orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    out = rows.join(files, ["query_id", "filename"], "left").withColumn("_place", of_file)
    return out.withColumn("promoted", F.coalesce(F.col("told"), F.lit(False)) & (F.col("_place") == 1) & (F.col("doc_class") == "content")).drop("told", "_place")


def rank_pool(queries: DataFrame, candidates: DataFrame, visible: DataFrame, limit: int) -> DataFrame:
    """Scores, promotes the best chunk of each file that reference texts mention, puts content first, caps each document.

    Routed chunks may be as many as there are: they are ranked without their texts, which only the best are given.
    """
    meta = visible.select("chunk_id", "doc_id", "filename", "doc_class", "chunk_signal")
    rows = promoted(queries, staged(candidates.join(meta, "chunk_id").withColumn("score", final_score()), "scored"), visible)
    tiers = [is_low_signal().cast("int"), (~F.col("promoted")).cast("int"), F.desc("_near"), F.col("chunk_id")]
    rows = rows.withColumn("_near", F.round("score", 9)).withColumn("of_doc", F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy(*tiers)))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy((F.col("of_doc") > PER_DOC).cast("int"), *tiers)))
    top = staged(rows.where(F.col("rank") <= max(1, limit)), "ranked")
    return top.join(visible.select("chunk_id", "content"), "chunk_id").select("query_id", "rank", "chunk_id", "doc_id", "filename", "chunk_signal", "content", "promoted", "score", *PARTS)


def hybrid_search(
    queries: DataFrame, documents: DataFrame, chunks: DataFrame, entities: DataFrame, vectors: DataFrame, posts: DataFrame, stats: DataFrame,
    edges: DataFrame | None = None, limit: int = 10, depth: int = 0, with_centrality: bool = False, visible: DataFrame | None = None, hidden: DataFrame | None = None,
) -> DataFrame:
    """Ranked results of all queries over the chunks of indexed documents.

    posts and stats are the inverted index, of all chunks or of the visible ones, and the visible ones' corpus_stats.
    Expansion through the graph (depth > 0, with edges) and centrality are off by default. visible and hidden:
    indexed_chunks and hidden_documents, where these are written already.
    """
    k = max(limit, 10)
    visible = indexed_chunks(chunks, documents) if visible is None else visible
    # Written: a table that is known to be small goes to the rows, which else would come to it.
    hidden = staged(hidden_documents(documents), "hidden") if hidden is None else hidden
    vec = vector_candidates(queries, only_visible(vectors, hidden, visible), k)
    lex = bm25(queries, posts, stats, k, hidden=hidden)
    ent = entity_candidates(queries, only_visible(entities, hidden, visible), k)
    rows = pool(vec, lex, ent)
    way = routed(queries, visible).select("query_id", "chunk_id", F.lit(1.0).alias("way"))
    rows = rows.join(way, ["query_id", "chunk_id"], "full").select("query_id", "chunk_id", *[F.coalesce(p, F.lit(0.0)).alias(p) for p in PARTS if p != "score_graph"], F.greatest(F.coalesce("score_graph", F.lit(0.0)), F.coalesce("way", F.lit(0.0))).alias("score_graph"))
    if edges is not None and depth > 0:
        meta = visible.select("chunk_id", "doc_class", "chunk_signal")
        grown = expand(seeds(rows.join(meta, "chunk_id").withColumn("score", final_score())), edges, visible, depth).withColumnRenamed("score", "grown")
        rows = rows.join(grown, ["query_id", "chunk_id"], "full").select("query_id", "chunk_id", *[F.coalesce(p, F.lit(0.0)).alias(p) for p in PARTS if p != "score_graph"], F.coalesce("grown", "score_graph", F.lit(0.0)).alias("score_graph"))
    if edges is not None and with_centrality:
        rows = rows.drop("score_centrality").join(centrality(edges), "chunk_id", "left").fillna(0.0, ["score_centrality"])
    # A few rows a query; written, so that ranking doesn't run the candidate scans again.
    return rank_pool(queries, staged(rows, "candidates"), visible, limit)
