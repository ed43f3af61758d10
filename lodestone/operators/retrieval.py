"""Vector search, keyword search, fusion, graph and evaluation over DataFrames."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS
from lodestone.operators import blocks
from lodestone.operators.shared import kept


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def magnitude(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    norm = magnitude(v)
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: (x.cast("double") / norm).cast("float")))


def knn(vectors: DataFrame, query: list[float], k: int, floor: float | None = None) -> DataFrame:
    """The k nearest by cosine distance (ties by id); the floor is applied after the cut, never filled up."""
    q = F.lit([float(np.float32(x)) for x in query])
    top = vectors.select("id", distance(F.col("embedding"), q).alias("distance")).orderBy("distance", "id").limit(k)
    return top if floor is None else top.where(F.col("distance") <= floor)


BLOCK = 4096


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances of rows in double precision, summed in the order of the components."""
    return 1.0 - np.add.accumulate(a.astype(np.float64) * b.astype(np.float64), axis=1)[:, -1] if len(a) else np.empty(0)


def _slack(q: np.ndarray, v: np.ndarray) -> float:
    """What a product of rows in single precision may be off by, at most (twice the bound)."""
    size = np.sqrt(float(np.einsum("ij,ij->i", q, q).max(initial=0)) * float(np.einsum("ij,ij->i", v, v).max(initial=0)))
    return 1.2e-7 * (q.shape[1] + 8) * max(1.0, size)


def _products(qi: np.ndarray, q: np.ndarray, chunks: list[blocks.Chunk], which: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, float]]:
    """(first query row, products in single precision, ids, vectors, slack) of blocks of queries with all chunks, -inf where an id is not asked for."""
    for c in chunks:
        if which == "earlier" and c.first >= qi.max():
            continue
        for begin in range(0, c.rows, BLOCK):
            vi, v = c.read(begin, begin + BLOCK)
            slack = _slack(q, v)
            for i in range(0, len(qi), 512):
                ids = qi[i : i + 512, None]
                if which == "earlier" and vi[0] >= ids.max():
                    continue
                m = q[i : i + 512] @ v.T
                if which == "other" and vi[0] <= ids.max() and ids.min() <= vi[-1]:
                    m[vi[None, :] == ids] = -np.inf
                elif which == "earlier" and vi[-1] >= ids.min():
                    m[vi[None, :] >= ids] = -np.inf
                yield i, m, vi, v, slack


def _scan(qi: np.ndarray, q: np.ndarray, chunks: list[blocks.Chunk], k: int, below: float | None, which: str) -> pa.RecordBatch:
    """The k nearest of each query among the chunks: what the k-th so far does not rule out is worked out exactly."""
    far, none = np.full((len(qi), k), np.inf), np.full((len(qi), k), np.iinfo(np.int64).max)
    for i, m, vi, v, slack in _products(qi, q, chunks, which):
        least = 1 - far[i : i + 512, k - 1]
        fresh = np.isinf(least)
        if k < len(vi) and fresh.any():
            least[fresh] = np.partition(m[fresh], len(vi) - k, axis=1)[:, len(vi) - k]
        least = np.maximum(least, -1e30 if below is None else 1 - below) - slack
        row, col = np.nonzero(m >= least[:, None].astype(np.float32))
        if not len(row):
            continue
        d = np.concatenate([exact(q[i + row[a : a + 65536]], v[col[a : a + 65536]]) for a in range(0, len(row), 65536)])
        if below is not None:
            row, col, d = row[d < below], col[d < below], d[d < below]
        held = np.unique(row)
        rows, ds, ids = np.concatenate([row, np.repeat(held, k)]), np.concatenate([d, far[i + held].ravel()]), np.concatenate([vi[col], none[i + held].ravel()])
        by = np.lexsort((ids, ds, rows))
        rows, ds, ids = rows[by], ds[by], ids[by]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        rows, ds, ids, rank = rows[rank < k], ds[rank < k], ids[rank < k], rank[rank < k]
        far[i + rows, rank], none[i + rows, rank] = ds, ids
    row, at = np.nonzero(np.isfinite(far))
    return pa.record_batch({"query_id": qi[row], "id": none[row, at], "distance": far[row, at]})


def nearest(queries: DataFrame, vectors: DataFrame, k: int, below: float | None = None, which: str = "any") -> DataFrame:
    """(query_id, id, distance, rank from 1): the k nearest of each query (query_id, embedding), ties by id.

    below: only what is nearer. which: any, other (not the query's own id) or earlier (smaller ids). Queries and vectors are
    written once; a task holds a block of queries and reads the vectors in chunks (a share of them, where there are too few blocks
    for all cores), so the pairs cost time but no disk, no shuffle and no memory. At most k rows a query leave a task."""
    chunks = blocks.store(vectors)
    asked = chunks if queries is vectors else blocks.store(queries.select(F.col("query_id").alias("id"), "embedding"))
    return _nearest(queries.sparkSession, asked, chunks, k, below, which)


def _nearest(spark: SparkSession, asked: list[blocks.Chunk], chunks: list[blocks.Chunk], k: int, below: float | None, which: str) -> DataFrame:
    packed = blocks.packed(asked, BLOCK)[::-1]  # of earlier ids the last blocks have most
    shares = max(1, min(len(chunks), -(-2 * spark.sparkContext.defaultParallelism // max(1, len(packed)))))
    works = [(p, s) for p in packed for s in range(shares)]
    found = blocks.each(spark, works, lambda w: [_scan(*blocks.load(w[0]), chunks[w[1] :: shares], k, below, which)], "query_id long, id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def edges(vectors: DataFrame, threshold: float, most: int = DEFAULTS.max_edges, which: str = "other", queries: DataFrame | None = None) -> DataFrame:
    """(source_id, target_id, distance): of each vector the nearest others under the threshold."""
    chunks = blocks.store(vectors)
    asked = chunks if queries is None else blocks.store(queries)
    return _nearest(vectors.sparkSession, asked, chunks, most, threshold, which).select(F.col("query_id").alias("source_id"), F.col("id").alias("target_id"), "distance")


def neighbours(vectors: DataFrame, threshold: float) -> DataFrame:
    """(source_id, target_id, distance) of all ordered pairs nearer than the threshold, distances in double precision.

    A task holds a block and reads the chunks before it; pairs leave it as they are found, both ways."""
    chunks = blocks.store(vectors)

    def near(work: list) -> Iterator[pa.RecordBatch]:
        qi, q = blocks.load(work)
        for i, m, vi, v, slack in _products(qi, q, chunks, "earlier"):
            row, col = np.nonzero(m >= np.float32(1 - threshold - slack))
            for a in range(0, len(row), 65536):
                r, c = row[a : a + 65536], col[a : a + 65536]
                d = exact(q[i + r], v[c])
                r, c, d = qi[i + r[d < threshold]], vi[c[d < threshold]], d[d < threshold]
                yield pa.record_batch({"source_id": np.concatenate([r, c]), "target_id": np.concatenate([c, r]), "distance": np.concatenate([d, d])})

    return blocks.each(vectors.sparkSession, blocks.packed(chunks, BLOCK)[::-1], near, "source_id long, target_id long, distance double")


def top_edges(pairs: DataFrame, most: int = DEFAULTS.max_edges) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy("distance", "target_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")


def greedy_near_dups(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, kept): in id order an item goes if an earlier kept one is near. ids: id, and kept where that is settled already.

    Decided in rounds: what has no undecided earlier neighbour is settled; each round is a join, and rounds end when nothing
    is open."""
    earlier = kept(pairs.where("target_id < source_id").select(F.col("source_id").alias("id"), F.col("target_id").alias("e")))
    settled = F.col("kept") if "kept" in ids.columns else F.lit(None).cast("boolean")
    state = ids.select("id", settled.alias("kept"))
    while True:
        seen = earlier.join(state.select(F.col("id").alias("e"), F.col("kept").alias("k")), "e").groupBy("id").agg(F.max(F.coalesce("k", F.lit(False))).alias("near"), F.max(F.col("k").isNull()).alias("open"))
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("near", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        state = kept(state.join(seen, "id", "left").select("id", new.alias("kept")))
        if state.where("kept IS NULL").isEmpty():
            return state


#: Rows that one round of leaders() takes on at first, and of which one task decides at most so many in order.
ROUND, DECIDED = 16384, 8192


def leaders(vectors: DataFrame, threshold: float) -> DataFrame:
    """(id) of vectors (id, embedding) that are kept when in order of id each goes that has a kept one before it nearer than the threshold.

    A round takes the next rows in order, drops in parallel those near to what is kept already, and decides the rest, so far as
    one task can, one after another. Rounds grow where little is left to decide. Pairs are never listed: only what is kept is written."""
    spark, at = vectors.sparkSession, blocks.place(vectors.sparkSession)
    chunks = blocks.store(vectors.repartitionByRange("id").sortWithinPartitions("id"))
    held: list[blocks.Chunk] = []
    begin, rows = (chunks[0].first if chunks else 0) - 1, ROUND

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each row of a is nearer to one of b."""
        m, slack = a @ b.T, _slack(a, b)
        best = m.max(axis=1, initial=-np.inf)
        out = best > 1 - threshold + slack
        for i in np.flatnonzero(~out & (best >= 1 - threshold - slack)):
            j = np.flatnonzero(m[i] >= 1 - threshold - slack)
            out[i] = (exact(np.broadcast_to(a[i], (len(j), a.shape[1])), b[j]) < threshold).any()
        return out

    def open_rows(work: tuple) -> Iterator[pa.RecordBatch]:
        slices, before = work
        ids, v = blocks.load(slices)
        for c in before:
            for b in range(0, c.rows, BLOCK):
                if len(ids):
                    gone = np.concatenate([near(v[i : i + 512], c.read(b, b + BLOCK)[1]) for i in range(0, len(ids), 512)])
                    ids, v = ids[~gone], v[~gone]
        if len(ids):
            yield blocks.rows_of([blocks.put(at, ids, v)])

    def decide(work: list[blocks.Chunk]) -> Iterator[pa.RecordBatch]:
        ids, v = blocks.load([(c, 0, c.rows) for c in work])
        ids, v, alive, kept_rows = ids[:DECIDED], v[:DECIDED], np.ones(min(len(ids), DECIDED), bool), []
        for i in range(len(ids)):
            if alive[i]:
                kept_rows.append(i)
                rest = i + 1 + np.flatnonzero(alive[i + 1 :])
                alive[rest[near(v[rest], v[i : i + 1])]] = False
        yield blocks.rows_of([blocks.put(at, ids[kept_rows], v[kept_rows])._replace(last=int(ids[-1]))])

    while True:
        ahead, n = [], 0
        for s in blocks.packed(chunks, BLOCK, begin):
            if n >= rows:
                break
            ahead.append(s)
            n += sum(b - a for _, a, b in s)
        if not ahead:
            break
        left = sorted((blocks.Chunk(*r) for r in blocks.each(spark, [(s, held) for s in ahead], open_rows, blocks.SCHEMA).collect()), key=lambda c: c.first)
        c, _, end = ahead[-1][-1]
        left_rows, begin = sum(c.rows for c in left), int(c.read(end - 1, end)[0][0])
        if left:
            new = blocks.Chunk(*blocks.each(spark, [left], decide, blocks.SCHEMA).first())
            held.append(new)
            begin = new.last if left_rows > DECIDED else begin
            for c in left:
                os.remove(c.path)
        rows = rows * 2 if left_rows < DECIDED // 2 else max(ROUND, rows // 2) if left_rows > DECIDED else rows
    return blocks.each(spark, held, lambda c: [pa.record_batch({"id": c.read()[0]})], "id long")


def rrf(lists: DataFrame, k: int, c: int = DEFAULTS.rrf_k) -> DataFrame:
    """Fuse ranked lists (query_id, list_no, rank from 1, id): (query_id, id, score, rank), ties by first appearance. If the
    lists have a distance, an item keeps that of its first appearance."""
    seen, more = F.struct("list_no", "rank"), []
    if "distance" in lists.columns:
        more = [F.min_by("distance", seen).alias("distance")]
    one = lists.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 12).alias("score"), F.min(seen).alias("seen"), *more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "seen")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("seen").select("query_id", "id", "score", "rank", *(["distance"] if more else []))


def percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """For each group the elements at the lower nearest ranks p/100 * (n - 1): counts by value, and where their running sum gets there."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy(value))
    ranked = counts.withColumn("__upto", upto).join(total, keys)
    return ranked.groupBy(*keys).agg(*[F.min(F.when(F.col("__upto") > F.floor(F.lit(p) / 100 * (F.col("__all") - 1)), F.col(value))).alias(name) for name, p in ps.items()])
