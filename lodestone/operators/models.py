"""What a model does, as a callable of the caller's: embedding, rewriting, ordering and checking.

An embedder takes a list of texts and returns a matrix; a generator takes a list of prompts and returns a list of replies.
Both run in tasks on Arrow batches, so they must be picklable. A generator that fails, or a reply that cannot be parsed, never
fails a query: the question stays as it is, the order stays the retrieved one, a claim is not checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS
from lodestone.functions import prompts
from lodestone.functions import text as T

#: What stands before a text that is embedded.
DOCUMENT, QUERY = "search_document: ", "search_query: "


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Generator(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class HashEmbedder:
    """A stand-in without a model: words hashed to signed dimensions. Deterministic; for tests and for trying things out."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        from zlib import crc32

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split()[1:]:  # the first is the prefix
                h = crc32(word.strip(".,;:!?\"'()").encode())
                out[i, h % self.dim] += 1 if h & 1 << 20 else -1
        return out


def normalised(m: np.ndarray) -> np.ndarray:
    """Rows of unit length in double precision, as single; a row of zeros stays."""
    m = np.asarray(m, np.float32)
    norm = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (m / np.where(norm == 0, 1, norm)).astype(np.float32)


def embed(df: DataFrame, embedder: Embedder, column: str = "text", prefix: str = DOCUMENT, name: str = "embedding") -> DataFrame:
    """df with the unit vector of a text column; a null text is the empty one."""

    @F.pandas_udf("array<float>")
    def vector(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in it:
            m = normalised(embedder([prefix + (x or "") for x in batch])) if len(batch) else np.empty((0, 0))
            yield pd.Series(list(m), index=batch.index)

    return df.withColumn(name, vector(F.col(column)))


def ask(prompt: Column, model: Generator) -> Column:
    """A model's replies to prompts; null where it fails or the prompt is null."""

    @F.pandas_udf("string")
    def reply(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in it:
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            asked = batch[batch.notna()]
            if len(asked):
                try:
                    out[asked.index] = list(model(asked.tolist()))
                except Exception:  # noqa: BLE001 - whatever a caller's model raises costs its help, not the query
                    pass
            yield out

    return reply(prompt)


def rewrite(questions: DataFrame, model: Generator | None, most: int = DEFAULTS.max_lookups) -> DataFrame:
    """(query_id, query_no, text) of questions (query_id, text): the question itself first, then up to ``most`` lookups of those that
    need several. Lookups that repeat the question or one another, whatever the case, are dropped; blank questions have no row."""
    q = questions.select("query_id", T.trim(F.col("text")).alias("text")).where("text <> ''")
    if model is None:
        return q.select("query_id", F.lit(0).alias("query_no"), "text")
    several = T.needs_decomposition(F.col("text"))
    asked = q.withColumn("reply", ask(F.when(several, prompts.rewrite(F.col("text"))), model))
    every = F.concat(F.array("text"), F.coalesce(T.lookups(F.col("reply")), F.array().cast("array<string>")))
    return asked.select("query_id", every.alias("a")).select("query_id", F.posexplode(F.slice(distinct_texts(F.col("a")), 1, most + 1)).alias("query_no", "text"))


def distinct_texts(a: Column) -> Column:
    """The first of texts that differ in case alone."""
    low = F.transform(a, F.lower)
    return F.filter(a, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def applied_order(reply: Column, n: Column) -> Column:
    """Places (from 0) in a model's order, those it left out after them in their own; garbage leaves all in place."""
    own = F.sequence(F.lit(0), n - 1)
    named = F.coalesce(T.rerank_order(reply, n), F.array().cast("array<int>"))
    return F.concat(named, F.array_except(own, named))


def rerank(questions: DataFrame, hits: DataFrame, model: Generator, top: int) -> DataFrame:
    """hits (query_id, rank, id, text, ...) of questions (query_id, text) in the model's order, ``top`` of each question, rank anew.
    A question with one hit is not asked. All of a question's hits (a pool, tens) stand in one row while it is asked."""
    pool = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text"))).alias("h"))
    texts = F.transform("h", lambda x: x["text"])
    asked = questions.select("query_id", F.col("text").alias("question")).join(pool, "query_id")
    asked = asked.withColumn("reply", ask(F.when(F.size("h") > 1, prompts.rerank(F.col("question"), texts)), model))
    order = F.slice(applied_order(F.col("reply"), F.size("h")), 1, top)
    placed = asked.select("query_id", "h", F.posexplode(order).alias("place", "was"))
    placed = placed.select("query_id", F.get("h", "was")["id"].alias("id"), (F.col("place") + 1).alias("rank"))
    return placed.join(hits.drop("rank"), ["query_id", "id"])


def verify(answers: DataFrame, passages: DataFrame, model: Generator, most: int = DEFAULTS.max_claims) -> DataFrame:
    """(query_id, claim_no, text, support, source_index) of answers (query_id, text) against passages (query_id, rank, text).

    The first ``most`` claims of an answer; support is supported, unsupported or not-checked (a hedge, a question, a short claim,
    or no reply)."""
    claims = answers.select("query_id", F.posexplode(F.slice(T.claims(F.col("text")), 1, most)).alias("claim_no", "text"))
    held = passages.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("p"))
    none = F.array().cast("array<string>")
    asked = claims.join(held, "query_id", "left").withColumn("p", F.coalesce("p", none))
    asked = asked.withColumn("reply", ask(F.when(T.is_factual(F.col("text")), prompts.verdict(F.col("text"), F.col("p"))), model))
    at = T.verdict(F.col("reply"), F.size("p"))
    support = F.when(F.col("reply").isNull(), "not-checked").when(at > 0, "supported").otherwise("unsupported")
    return asked.select("query_id", "claim_no", "text", support.alias("support"), F.when(F.col("reply").isNull(), 0).otherwise(at).alias("source_index"))


def grounded(claims: DataFrame) -> DataFrame:
    """(query_id, checked, supported, unsupported, groundedness, report) of verify()'s rows; groundedness is 0 when nothing was checked."""
    is_a = lambda kind: F.count(F.when(F.col("support") == kind, 1))
    bad = F.transform(F.array_sort(F.collect_list(F.when(F.col("support") == "unsupported", F.struct("claim_no", "text")))), lambda x: x["text"])
    out = claims.groupBy("query_id").agg(is_a("supported").alias("supported"), is_a("unsupported").alias("unsupported"), bad.alias("bad"))
    out = out.withColumn("checked", F.col("supported") + F.col("unsupported"))
    share = F.when(F.col("checked") > 0, F.col("supported") / F.col("checked")).otherwise(0.0)
    return out.select("query_id", "checked", "supported", "unsupported", share.alias("groundedness"), prompts.grounding(F.col("checked"), F.col("supported"), F.col("bad")).alias("report"))


def driver_side(model: Callable[[str], str]) -> Generator:
    """A callable of one prompt as one of a list."""
    return lambda many: [model(x) for x in many]
