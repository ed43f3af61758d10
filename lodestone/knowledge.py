"""A knowledge base: one method for each thing a user does with a store of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.functions import text as T
from lodestone.functions.errors import Refused
from lodestone.operators import chunking, documents, graph, keyword, models, retrieve
from lodestone.operators import retrieval as R
from lodestone.operators.shared import kept, ordinals
from lodestone.sources import files
from lodestone.sources.store import Store


class KnowledgeBase:
    def __init__(self, spark: SparkSession, path: str, embedder: models.Embedder | None = None, rewriter: models.Generator | None = None, reranker: models.Generator | None = None,
                 verifier: models.Generator | None = None, settings: Settings = DEFAULTS):
        self.spark, self.store, self.settings = spark, Store(spark, path), settings
        self.embedder, self.rewriter, self.reranker, self.verifier = embedder or models.HashEmbedder(), rewriter, reranker, verifier

    # ---- writing

    def add(self, texts: DataFrame) -> DataFrame:
        """Ingest texts (text, source, origin; seq if the order of rows matters). Returns (doc_key, outcome, n_chunks).

        A document (a file, a page) that is as it was is skipped (unchanged), else its chunks are replaced (saved). Of several rows
        of one document the last counts. Notes are added, chunk by chunk, where nothing stored or before them is nearly the same.
        Null, blank and oversized texts are refused, each on its own."""
        s, meta = self.settings, self.store.meta()
        seq = F.col("seq").cast("long") if "seq" in texts.columns else F.monotonically_increasing_id()
        rows = texts.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("origin", F.lit("")).alias("origin"), seq.alias("seq"))
        rows = kept(rows)
        is_document = T.replaceable(F.col("source"), F.col("origin"))
        key = F.when(is_document, T.doc_key(F.col("source"), F.col("origin"), F.lit(0)))
        rows = rows.select("*", key.alias("key"), F.sha2("text", 256).alias("hash"))
        last = rows.where("key IS NOT NULL").groupBy("key").agg(F.max_by(F.struct("text", "source", "origin", "hash"), F.struct("seq", "hash")).alias("r"), F.max("seq").alias("seq")).select("key", "r.*", "seq")
        notes = rows.where("key IS NULL").select("key", "text", "source", "origin", "hash", "seq")
        known = self.store.read("documents", meta).select(F.col("doc_key").alias("key"), F.col("hash").alias("old"))
        refused = F.when(T.trim(F.col("text")) == "", "empty").when(F.octet_length("text") > s.max_bytes, "too long")
        judged = last.join(known, "key", "left").unionByName(notes.withColumn("old", F.lit(None).cast("string"))).withColumn("why", F.coalesce(refused, F.when(F.col("old") == F.col("hash"), "unchanged")))
        todo = judged.withColumn("text", F.when(F.col("why").isNull(), F.col("text"))).withColumn("doc", F.monotonically_increasing_id())
        todo = kept(todo)
        fresh = todo.where("why IS NULL")
        kind = T.content_type(F.col("source"))
        facts = fresh.select(F.col("doc").alias("id"), "text", "key", "source", "origin", T.doc_title(F.col("source"), F.col("origin")).alias("doc_title"), kind.alias("content_type"), "seq", "hash")
        pieces = chunking.chunk(facts, s, ("key", "source", "origin", "doc_title", "content_type", "seq", "hash")).where("error IS NULL").drop("error")
        pieces = ordinals(pieces, [], ["seq", "hash", "source", "id", "chunk_index"], "new", int(meta["next_id"])).drop("seq", "hash")
        pieces = kept(models.embed(pieces, self.embedder))
        gone = self._chunks(meta).join(fresh.select(F.col("key").alias("doc_key")), "doc_key", "left_semi").select("id")
        gone = kept(gone)
        vectors = kept(self.store.read("vectors", meta).join(gone, "id", "left_anti"))
        pieces = self._without_near_duplicates(pieces, vectors)
        new = pieces.select(F.col("new").alias("id"), "embedding")
        every = vectors.unionByName(new)
        edges = R.edges(every, s.edge_threshold, s.max_edges, "earlier", new)
        stamp = F.date_trunc("second", F.current_timestamp())
        chunks = pieces.select(F.col("new").alias("id"), "text", "source", "origin", stamp.alias("created_at"), "heading_path", "chunk_index", "doc_title", "content_type", T.doc_key(F.col("source"), F.col("origin"), F.col("new")).alias("doc_key"))
        hashes = fresh.where("key IS NOT NULL").select(F.col("key").alias("doc_key"), "hash", stamp.alias("updated_at"))
        top = pieces.agg(F.max("new")).first()[0]
        self.store.commit(meta, {"chunks": chunks, "vectors": new, "relations": edges, "documents": hashes}, self._gone(gone) | {"documents": (hashes, ["doc_key"])}, next_id=max(int(meta["next_id"]), (top or 0) + 1))
        n = pieces.groupBy("id").agg(F.count(F.lit(1)).alias("n_chunks")).withColumnRenamed("id", "doc")
        outcome = F.coalesce("why", F.when(F.coalesce("n_chunks", F.lit(0)) > 0, "saved").otherwise("too similar"))
        return todo.join(n, "doc", "left").select(F.coalesce("key", F.lit("")).alias("doc_key"), outcome.alias("outcome"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))

    def _without_near_duplicates(self, pieces: DataFrame, vectors: DataFrame) -> DataFrame:
        """Chunks of notes go if a stored vector, or a kept chunk before them, is nearly the same."""
        s, notes = self.settings, pieces.where("key IS NULL")
        if notes.isEmpty():
            return pieces
        asked = notes.select(F.col("new").alias("query_id"), "embedding")
        near = R.nearest(asked, vectors.unionByName(pieces.where("key IS NOT NULL").select(F.col("new").alias("id"), "embedding")), 1, s.dedup_distance + 1e-12, "earlier").select("query_id")
        left = kept(asked.join(near, "query_id", "left_anti").withColumnRenamed("query_id", "id"))
        stay = R.leaders(left, s.dedup_distance + 1e-12)
        out = notes.select("new").join(stay.withColumnRenamed("id", "new"), "new", "left_anti")
        return kept(pieces.join(out, "new", "left_anti"))

    @staticmethod
    def _gone(ids: DataFrame) -> dict:
        """Tombstones of chunks (id) in every table that knows them."""
        return {"chunks": (ids, ["id"]), "vectors": (ids, ["id"])}

    def add_pages(self, pages: DataFrame) -> DataFrame:
        """Ingest captured pages (text, url, title): the title is the source, or the url without one; the url is the origin."""
        title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.col("url"))
        return self.add(pages.select("text", title.alias("source"), F.coalesce("url", F.lit("")).alias("origin")))

    def add_files(self, found: DataFrame, pdf=None) -> DataFrame:
        """Ingest files (path, content, modificationTime): of one path the newest counts. Unsupported names are not taken."""
        texts = files.extract(found, pdf)
        bare = F.regexp_replace("path", "^file:/*", "/")
        return self.add(texts.where("error IS NULL").select("text", bare.alias("source"), F.lit("").alias("origin"), F.unix_micros("modificationTime").alias("seq")))

    def delete(self, spec: str) -> int:
        """Delete chunks by numbers, as in 1,5,7-9; their vectors and edges go along. Returns how many chunks there were."""
        ids = self.spark.range(1).select(T.delete_spec(F.lit(spec)).alias("ids"))
        if ids.first()[0] is None:
            raise Refused(f"{spec!r} is no list of numbers")
        return self._delete(ids.select(F.explode("ids").alias("id")))

    def delete_document(self, source: str, origin: str = "") -> int:
        """Delete a document's chunks: those of the origin, or of the source where there is no origin."""
        c = self._chunks(self.store.meta())
        return self._delete(c.where(F.col("origin") == origin).select("id") if origin else c.where((F.col("source") == source) & (F.col("origin") == "")).select("id"))

    def _delete(self, ids: DataFrame) -> int:
        meta = self.store.meta()
        ids = kept(self._chunks(meta).join(ids, "id", "left_semi").select("id"))
        n = ids.count()
        if n:
            self.store.commit(meta, None, self._gone(ids))
        return n

    def replace_vector(self, vectors: DataFrame) -> int:
        """New vectors (id, embedding) for chunks that are there."""
        meta = self.store.meta()
        v = kept(vectors.join(self._chunks(meta), "id", "left_semi").select("id", "embedding"))
        return self.store.commit(meta, {"vectors": v}, {"vectors": (v, ["id"])})

    def reindex(self) -> int:
        """Embed all chunks anew and link them again."""
        meta = self.store.meta()
        v = kept(models.embed(self._chunks(meta).select("id", "text"), self.embedder).select("id", "embedding"))
        meta["tables"]["vectors"], meta["tables"]["relations"] = [], []
        return self.store.commit(meta, {"vectors": v, "relations": R.edges(v, self.settings.edge_threshold, self.settings.max_edges)})

    def reindex_edges(self, threshold: float = 0.6) -> int:
        """Link all chunks again: of each the nearest under the threshold."""
        meta = self.store.meta()
        meta["tables"]["relations"] = []
        return self.store.commit(meta, {"relations": R.edges(self.store.read("vectors", meta), threshold, self.settings.max_edges)})

    def clear(self) -> None:
        self.store.clear()

    # ---- reading

    def _chunks(self, meta: dict) -> DataFrame:
        return self.store.read("chunks", meta)

    def relations(self) -> DataFrame:
        """Edges both of whose chunks are there."""
        meta = self.store.meta()
        ids = self._chunks(meta).select("id")
        e = self.store.read("relations", meta).dropDuplicates(["source_id", "target_id"])
        return e.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")

    def list(self) -> DataFrame:
        """All chunks, the newest first."""
        return self._chunks(self.store.meta()).orderBy(F.desc("created_at"), F.desc("id"))

    def corpus(self) -> retrieve.Corpus:
        """Chunks, vectors and the keyword index of the newest version; the index is kept beside the version it is of."""
        meta = self.store.meta()
        at = f"{self.store.path}/keywords/{meta['version']}"
        c = self._chunks(meta)
        if not self.store.system.exists(self.store._path(f"{at}/lengths/_SUCCESS")):
            keyword.build(c.select("id", "text")).save(at)
        return retrieve.Corpus(c, self.store.read("vectors", meta), keyword.Index.load(self.spark, at))

    def _one(self, question: str) -> DataFrame:
        return self.spark.range(1).select(F.col("id").alias("query_id"), F.lit(question).alias("text"))

    def search_all(self, questions: DataFrame, limit: int | None = None) -> DataFrame:
        """The API's search for many questions (query_id, text): rank, chunk, document, place in it, snippet, score and distance."""
        s, corpus = self.settings, self.corpus()
        n = min(limit if limit and limit > 0 else s.top_k, s.api_limit)
        asked = questions.select("query_id", T.trim(F.col("text")).alias("text"))
        hits = kept(retrieve.retrieve(corpus, asked, self.embedder, n, s.search_distance, self.rewriter, self.reranker, s))
        own = corpus.chunks.join(hits.select("doc_key").distinct(), "doc_key", "left_semi").select("doc_key", "id", "chunk_index")
        place = ordinals(own, ["doc_key"], ["chunk_index", "id"], "place").select("id", "place")
        path = F.when(F.col("origin") != "", F.col("origin")).otherwise(F.col("source"))
        return hits.join(place, "id").select(
            "query_id", "rank", F.col("id").alias("chunk_id"), F.col("doc_key").alias("document_id"), path.alias("path"), F.col("source").alias("label"), F.col("place").alias("chunk_index"),
            T.truncate(F.col("text"), s.snippet_chars).alias("snippet"), "score", "distance", documents.stamp(F.col("created_at")).alias("saved_at"),
        )

    def search(self, question: str, limit: int | None = None) -> DataFrame:
        if not question.strip():
            raise Refused("the question is empty")
        return self.search_all(self._one(question), limit).drop("query_id").orderBy("rank")

    def _resolve(self, identifier: str) -> str:
        if not identifier.strip():
            raise Refused("the identifier is empty")
        row = documents.resolve(self._chunks(self.store.meta()), self.spark.range(1).select(F.lit(identifier).alias("identifier"))).first()
        if row is None:
            raise LookupError(f"no stored document matches {identifier!r}")
        return row["doc_key"]

    def document(self, identifier: str) -> DataFrame:
        """The API's document: by number, origin, source or the end of a name."""
        key, meta = self._resolve(identifier), self.store.meta()
        found = documents.fetch(self._chunks(meta), self.spark.range(1).select(F.lit(key).alias("doc_key")), self.store.read("documents", meta))
        names = [x for x in (found.select("source", "origin").first() or ()) if x.startswith("/") and self.store.system.exists(self.store._path(x))]
        if not names:
            return documents.payload(found, None, self.settings.document_chars)
        held = kept(self.spark.read.format("binaryFile").load(names))
        now = files.extract(held).join(held.select("path", "length"), "path")
        return documents.payload(found, now, self.settings.document_chars)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes (documents) and edges between them."""
        c = self._chunks(self.store.meta())
        return graph.nodes(c), graph.project(self.relations(), c.select("id", "doc_key"))

    def neighbourhood(self, identifier: str, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
        """The API's graph: nodes within depth hops (1 by default) with a preview, and the edges among them."""
        key, s = self._resolve(identifier), self.settings
        nodes, edges = self.graph()
        nodes = kept(nodes)
        found, inside = graph.neighbourhood(nodes, edges, key, min(depth if depth and depth > 0 else 1, s.max_depth))
        ids = nodes.select("doc_key", "id")
        a, b = ids.select(F.col("doc_key").alias("a"), F.col("id").alias("source_node_id")), ids.select(F.col("doc_key").alias("b"), F.col("id").alias("target_node_id"))
        shown = found.select(F.col("id").alias("node_id"), F.col("doc_key").alias("document_id"), "label", F.col("open").alias("path"), "depth", T.truncate(F.col("text"), s.preview_chars).alias("preview"))
        return shown, inside.join(a, "a").join(b, "b").select("source_node_id", "target_node_id", "distance", (1 - F.col("distance")).alias("similarity"))

    def query(self, question: str, generator: models.Generator, **options) -> str:
        """An answer: a line of sources, the generator's text, and a grounding report where there is a verifier."""
        options = {"rewriter": self.rewriter, "reranker": self.reranker, "distance": self.settings.search_distance, "top": self.settings.top_k} | options
        return retrieve.query(self.corpus(), self._one(question), self.embedder, generator, self.verifier, **options).first()["stream"]

    def debug(self, question: str) -> DataFrame:
        """The nearest 20 chunks with their bare distances."""
        corpus = self.corpus()
        asked = models.embed(self._one(question), self.embedder, "text", models.QUERY)
        return R.nearest(asked, corpus.vectors, self.settings.pool).join(corpus.chunks, "id").select("rank", "id", "distance", "source", "text").orderBy("rank")

    def debug_prompt(self, question: str) -> str:
        """The prompt a question would have."""
        bare = self._one(question).select("query_id", T.query_flags(F.col("text"))["question"].alias("text"))
        hits = kept(retrieve.retrieve(self.corpus(), bare, self.embedder, self.settings.top_k, self.settings.search_distance, self.rewriter, self.reranker, self.settings))
        return retrieve.answer_prompts(self._one(question), hits).first()["prompt"]

    def nearest_pairs(self) -> DataFrame:
        """Of each chunk the nearest other one, the nearest pairs first."""
        return R.edges(self.store.read("vectors"), 3.0, 1).orderBy("distance", "source_id")

    def diagnose(self) -> DataFrame:
        """Counts, the store's format, and whether vectors have unit length."""
        size = R.magnitude(F.col("embedding"))
        lengths = self.store.read("vectors").agg(F.min(size).alias("shortest"), F.max(size).alias("longest"), F.avg(size).alias("mean_length"))
        return self.store.counts().crossJoin(lengths)  # one row each


def pending(paths: DataFrame, claimed: DataFrame) -> DataFrame:
    """Files (path, ...) that no claim (path) says have been ingested another way; a claim holds for one row."""
    count = ordinals(paths, ["path"], ["version"], "__n", 1) if "version" in paths.columns else paths.withColumn("__n", F.lit(1).cast("long"))
    claims = claimed.groupBy("path").agg(F.count(F.lit(1)).alias("__claims"))
    return count.join(claims, "path", "left").where(F.col("__n") > F.coalesce("__claims", F.lit(0))).drop("__n", "__claims")

