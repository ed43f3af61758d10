"""Retrieval for many questions at once: vectors and keywords fused by rank, over rewritten questions, reranked by a model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.functions import prompts
from lodestone.functions import text as T
from lodestone.operators import keyword, models
from lodestone.operators import retrieval as R
from lodestone.operators.shared import kept


@dataclass(frozen=True)
class Corpus:
    """chunks (id, text, source, origin, created_at, heading_path, chunk_index, doc_title, ...), vectors (id, embedding), keyword index."""

    chunks: DataFrame
    vectors: DataFrame
    index: keyword.Index


def candidates(corpus: Corpus, queries: DataFrame, embedder: models.Embedder, limit: int, distance: float, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, id, score, rank, distance) of queries (query_id, text): a pool by vectors within the distance and one by keywords,
    fused; an item that only keywords found has distance 0."""
    pool = max(limit, s.pool)
    asked = kept(models.embed(queries, embedder, "text", models.QUERY))
    near = R.nearest(asked.select("query_id", "embedding"), corpus.vectors, pool).where(F.col("distance") <= distance)
    words = keyword.bm25(corpus.index, queries, pool)
    lists = near.select("query_id", F.lit(0).alias("list_no"), "rank", "id", "distance").union(words.select("query_id", F.lit(1).alias("list_no"), "rank", "id", F.lit(0.0).alias("distance")))
    return R.rrf(lists, limit, s.rrf_k)


def retrieve(corpus: Corpus, questions: DataFrame, embedder: models.Embedder, top: int = DEFAULTS.top_k, distance: float = DEFAULTS.search_distance,
             rewriter: models.Generator | None = None, reranker: models.Generator | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """(query_id, rank, id, score, distance, and the chunk's columns) of questions (query_id, text), ``top`` of each.

    With a reranker more is fetched and cut down by it; it is asked the question as it was put. Questions that the rewriter splits
    are fused from the rankings of all their lookups; others pass the second fusion by."""
    fetch = max(s.rerank_pool, top) if reranker else top
    queries = models.rewrite(questions, rewriter, s.max_lookups)
    queries = kept(queries.withColumn("__q", F.xxhash64("query_id", "query_no")))
    found = candidates(corpus, queries.select(F.col("__q").alias("query_id"), "text"), embedder, fetch, distance, s)
    found = found.withColumnRenamed("query_id", "__q").join(queries.select("__q", "query_id", "query_no"), "__q")
    if rewriter is None:
        hits = found.select("query_id", "id", "score", "rank", "distance")
    else:
        number = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        found = kept(found.join(number, "query_id"))
        alone = found.where("n = 1").select("query_id", "id", "score", "rank", "distance")
        several = found.where("n > 1").select("query_id", F.col("query_no").alias("list_no"), "rank", "id", "distance")
        hits = alone.union(R.rrf(several, fetch, s.rrf_k).select("query_id", "id", "score", "rank", "distance"))
    hits = hits.join(corpus.chunks, "id")
    return models.rerank(questions, hits, reranker, top) if reranker else hits.where(F.col("rank") <= top)


def sources(hits: DataFrame) -> DataFrame:
    """(query_id, source, rank): the different linkable sources of hits, in the order of their first hit."""
    name = F.when(F.col("origin") != "", F.col("origin")).otherwise(F.col("source"))
    rows = hits.where(T.is_linkable(name)).select("query_id", name.alias("source"), "rank")
    return rows.groupBy("query_id", "source").agg(F.min("rank").alias("rank"))


def answer_prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, prompt) of questions (query_id, text, with their flags) from their hits; one without hits asks for general knowledge."""
    q = questions.select("query_id", T.query_flags(F.col("text")).alias("f")).select("query_id", "f.*")
    passage = F.struct("rank", "text", "doc_title", "source", "origin", "heading_path", "created_at")
    held = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(passage)).alias("p"))  # top hits of a question
    made = prompts.answer(F.col("question"), F.col("p"), F.col("date"), F.col("source"))
    return q.join(held, "query_id", "left").select("query_id", F.when(F.col("p").isNull(), prompts.without_context(F.col("question"))).otherwise(made).alias("prompt"))


def protocol(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """(query_id, stream): a line {"sources": [...]} and then the answer (query_id, text)."""
    named = sources(hits).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("sources"))
    out = answers.join(named, "query_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))
    return out.select("query_id", F.concat(F.to_json(F.struct("sources")), F.lit("\n"), "text").alias("stream"))


def query(corpus: Corpus, questions: DataFrame, embedder: models.Embedder, generator: models.Generator, verifier: models.Generator | None = None, **options) -> DataFrame:
    """(query_id, stream) of questions with flags: retrieved, prompted, answered and, with a verifier, followed by a grounding report."""
    bare = questions.select("query_id", T.query_flags(F.col("text"))["question"].alias("text"))
    hits = kept(retrieve(corpus, bare, embedder, **options))
    answers = kept(answer_prompts(questions, hits).select("query_id", F.coalesce(models.ask(F.col("prompt"), generator), F.lit("")).alias("text")))
    if verifier:
        report = models.grounded(models.verify(answers, hits.select("query_id", "rank", "text"), verifier)).select("query_id", "report")
        answers = answers.join(report, "query_id", "left").select("query_id", F.concat("text", F.coalesce("report", F.lit(""))).alias("text"))
    return protocol(hits, answers)
