"""Approximate search: a hierarchical small-world graph (Malkov and Yashunin 2016) for each share of the vectors, answers merged.

Graphs are built once and kept as rows of a table (build, then write it); a search reads them and builds nothing. There are at most
GRAPHS of them by default, so what a question costs grows with the logarithm of the rows: a larger table has larger graphs."""

from __future__ import annotations

import heapq
import math
import pickle
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import blocks
from lodestone.operators.retrieval import exact

FORMAT = 2
#: Graphs of an index, at most; products that are held at a time while one is filled.
GRAPHS, PRODUCTS = 64, 1 << 22


def pick(d: np.ndarray, v: np.ndarray, most: int) -> list[int]:
    """Places of candidates (distances in order, vectors) that are not nearer to one picked before; filled up with the nearest left over."""
    if len(d) <= 1:
        return list(range(min(len(d), most)))
    chosen, open_ = [], np.ones(len(d), bool)
    while len(chosen) < most:
        i = int(open_.argmax())
        if not open_[i]:
            break
        chosen.append(i)
        open_ &= 1 - v @ v[i] > d
        open_[i] = False
    if len(chosen) < most:
        held = set(chosen)
        chosen += [i for i in range(min(len(d), most + len(chosen))) if i not in held][: most - len(chosen)]
    return chosen


class Graph:
    def __init__(self, dim: int, m: int = 16, build: int = 200, seed: int = 42):
        self.dim, self.m, self.build, self.rng = dim, m or 16, build or 200, np.random.default_rng(seed)
        self.rows = np.empty((64, dim), np.float32)  # of the nodes so far, and room for more
        self.ids: list[list[int]] = []  # in order, of all rows with a node's vector; none: replaced since
        self.place: dict[int, int] = {}
        self.links: list[list[list[int]]] = []
        self.entry, self.top, self.gone = -1, -1, 0  # gone: nodes without ids

    @property
    def vectors(self) -> np.ndarray:
        return self.rows[: len(self.ids)]

    def _far(self, q: np.ndarray, nodes: list[int]) -> list[float]:
        return (1 - self.rows.take(nodes, axis=0) @ q).tolist() if nodes else []

    def _search(self, q: np.ndarray, starts: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        seen, first = set(starts), list(zip(self._far(q, starts), starts, strict=True))
        open_, best = list(first), [(-d, i) for d, i in first]
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            d, i = heapq.heappop(open_)
            if len(best) >= ef and d > -best[0][0]:
                break
            new = [j for j in self.links[i][layer] if j not in seen]
            seen.update(new)
            for dj, j in zip(self._far(q, new), new, strict=True):
                if len(best) < ef or dj < -best[0][0]:
                    heapq.heappush(open_, (dj, j))
                    heapq.heappush(best, (-dj, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def _choose(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Near ones that are not nearer to one chosen before; filled up with the nearest left over."""
        nodes = [i for _, i in found]
        return [nodes[i] for i in pick(np.array([d for d, _ in found], np.float32), self.rows[nodes], most)]

    def _level(self) -> int:
        return int(-math.log(1 - self.rng.random()) / math.log(self.m))

    def add(self, id: int, vector: np.ndarray) -> None:
        if len(vector) != self.dim:
            raise ValueError(f"{len(vector)} dimensions instead of {self.dim}")
        if id in self.place:
            held = self.ids[self.place[id]]
            held.remove(id)  # the node stays as a way through
            self.gone += not held
        level, node = self._level(), len(self.ids)
        if node == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty((max(64, node), self.dim), np.float32)])
        self.rows[node] = vector
        self.ids.append([id])
        self.place[id] = node
        self.links.append([[] for _ in range(level + 1)])
        if self.entry >= 0:
            near = [self.entry]
            for layer in range(self.top, level, -1):
                near = [self._search(vector, near, 1, layer)[0][1]]
            for layer in range(min(level, self.top), -1, -1):
                found = self._search(vector, near, self.build, layer)
                most = self.m * (2 if layer == 0 else 1)
                self.links[node][layer] = self._choose(found, self.m)
                for j in self.links[node][layer]:
                    mine = self.links[j][layer]
                    mine.append(node)
                    if len(mine) > most:
                        self.links[j][layer] = self._choose(sorted(zip(self._far(self.vectors[j], mine), mine, strict=True)), most)
                near = [i for _, i in found]
        if level > self.top:
            self.entry, self.top = node, level

    def fill(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Different ids, ascending, and their rows into an empty graph: as by add() in their order, but the candidates of a node are the
        exactly nearest of those before it, by products of blocks; lists are cut once; equal rows are one node."""
        if self.ids or v.shape[1] != self.dim:
            raise ValueError(f"not empty, or {v.shape[1]} dimensions instead of {self.dim}")
        seen: dict[bytes, int] = {}
        for id, row in zip(ids.tolist(), np.ascontiguousarray(v, np.float32), strict=True):
            node = seen.setdefault(row.tobytes(), len(self.ids))
            if node == len(self.ids):
                self.ids.append([])
            self.ids[node].append(id)
            self.place[id] = node
        if self.ids:
            self.rows = np.ascontiguousarray(v[np.searchsorted(ids, [x[0] for x in self.ids])], np.float32)
        levels = np.array([self._level() for _ in self.ids], np.int64)
        self.links = [[[] for _ in range(n + 1)] for n in levels.tolist()]
        self.top = int(levels.max(initial=-1))
        self.entry = int(levels.argmax()) if len(levels) else -1
        for layer in range(self.top + 1):
            self._connect(np.flatnonzero(levels >= layer), layer)

    def _connect(self, nodes: np.ndarray, layer: int) -> None:
        w, most, begin = self.rows[nodes], self.m * (2 if layer == 0 else 1), 0
        out: list[list[int]] = [[] for _ in range(len(nodes))]
        while begin < len(nodes):
            end = min(len(nodes), begin + max(1, min(512, PRODUCTS // (begin + 512))))
            far = 1 - w[begin:end] @ w[:end].T
            far[np.arange(begin, end)[:, None] <= np.arange(end)] = np.inf
            near = np.argpartition(far, self.build, axis=1)[:, : self.build] if end > self.build else np.broadcast_to(np.arange(end), far.shape)
            d = np.take_along_axis(far, near, 1)
            by = np.lexsort((near, d))
            near, d = np.take_along_axis(near, by, 1), np.take_along_axis(d, by, 1)
            for i, (c, x) in enumerate(zip(near, d, strict=True), begin):
                c, x = c[: min(i, len(c))], x[: min(i, len(c))]
                out[i] = c[pick(x, w[c], self.m)].tolist()
            begin = end
        for i, chosen in enumerate([list(c) for c in out]):
            for j in chosen:
                out[j].append(i)
        for i, mine in enumerate(out):
            if len(mine) > most:
                c = np.array(mine)
                x = 1 - w[c] @ w[i]
                by = np.lexsort((c, x))
                mine = c[by][pick(x[by], w[c[by]], most)].tolist()
            self.links[nodes[i]][layer] = nodes[mine].tolist()

    def __len__(self) -> int:
        return len(self.place)

    def search(self, q: np.ndarray, k: int, ef: int = 64) -> list[tuple[float, int]]:
        if self.entry < 0 or k <= 0:
            return []
        if len(q) != self.dim:
            raise ValueError(f"{len(q)} dimensions instead of {self.dim}")
        near = [self.entry]
        for layer in range(self.top, 0, -1):
            near = [self._search(q, near, 1, layer)[0][1]]
        found = [i for _, i in self._search(q, near, max(ef, k) + min(self.gone, ef), 0)]
        v = self.rows[found]
        far = exact(np.broadcast_to(np.asarray(q), v.shape), v).tolist()  # the same for the same vector in every graph
        return sorted((d, id) for d, i in zip(far, found, strict=True) for id in self.ids[i][:k])[:k]

    def bytes(self) -> int:
        """Vectors and links in memory."""
        return 4 * self.dim * len(self.ids) + 8 * sum(len(layer) for node in self.links for layer in node)

    def dump(self) -> bytes:
        return pickle.dumps({"format": FORMAT, "dim": self.dim, "m": self.m, "build": self.build, "rng": self.rng, "rows": self.vectors, "ids": self.ids, "gone": self.gone, "place": self.place, "links": self.links, "entry": self.entry, "top": self.top})

    @classmethod
    def restore(cls, data: bytes) -> Graph:
        held = pickle.loads(data)  # noqa: S301 - written by dump() into a table of the user's own
        if held.pop("format", None) != FORMAT:
            raise ValueError("an index of another format")
        out = cls(held["dim"], held["m"], held["build"])
        out.__dict__.update(held)
        return out


def build(vectors: DataFrame, rows: int = 5000, m: int = 16, effort: int = 200, most: int = GRAPHS) -> DataFrame:
    """(part, n, graph): an index of vectors (id, embedding), a graph for about ``rows`` of them, or for more where that would be more
    than ``most`` graphs. Of repeated ids the last in a part counts."""
    parts = max(1, min(most, -(-vectors.count() // rows)))

    def graph(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf[["id", "embedding"]].sort_values("id", kind="stable").drop_duplicates("id", keep="last")
        out = Graph(len(held["embedding"].iloc[0]), m, effort)
        out.fill(held["id"].to_numpy(np.int64), np.stack(held["embedding"].to_list()).astype(np.float32, copy=False))
        return pd.DataFrame({"part": [key[0]], "n": [len(out)], "graph": [out.dump()]})

    dealt = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    # the number is stated, as building a graph takes long for its few bytes and small partitions would be merged
    return dealt.repartition(parts, "part").groupBy("part").applyInPandas(graph, "part int, n long, graph binary")


def search(index: DataFrame, queries: DataFrame, k: int, ef: int = 64, block: int = 2000) -> DataFrame:
    """(query_id, id, distance, rank) of queries (query_id, embedding), which meet every graph. Queries are written once as files in the
    shared folder; a task holds one graph and reads them in blocks, so neither graphs nor queries are copied."""
    asked = blocks.packed(blocks.store(queries.select(F.col("query_id").alias("id"), "embedding")), block)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for data in batch["graph"]:
                held = Graph.restore(data.as_py())
                for slices in asked:
                    rows = [(i, j, d) for i, q in zip(*blocks.load(slices), strict=True) for d, j in held.search(q, k, ef)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "distance"])

    # a partition for each graph, as it is; hashed, several would meet in one
    local = index.select("part", "graph").repartitionById(GRAPHS, F.pmod("part", F.lit(GRAPHS))).select("graph").mapInArrow(run, "query_id long, id long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


CENTRES, SPREAD = 60, 0.35


def clustered(n: int, dim: int, seed: int = 42, first: int = 0) -> np.ndarray:
    """Unit vectors around CENTRES random directions, at about SPREAD from them in all; the numbers first to first + n of a seed."""
    centres = np.random.default_rng(seed).standard_normal((CENTRES, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rng = np.random.default_rng([seed, first])
    v = centres[rng.integers(0, CENTRES, n)] + rng.standard_normal((n, dim)) * SPREAD / math.sqrt(dim)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def synthetic(spark: SparkSession, n: int, dim: int = 768, seed: int = 42, rows: int = 2000) -> DataFrame:
    """(id, embedding): n clustered vectors, made in tasks, the same for the same seed."""

    def make(it):
        for pdf in it:
            for first in pdf["id"]:
                v = clustered(min(rows, n - int(first)), dim, seed, int(first))
                yield pd.DataFrame({"id": np.arange(first, first + len(v)), "embedding": list(v)})

    return spark.range(0, n, rows, max(1, -(-n // rows))).mapInPandas(make, "id long, embedding array<float>")


def sweep(spark: SparkSession, sizes=(1000, 5000), efs=(64,), dim: int = 768, k: int = 10, questions: int = 25, m: int = 16, effort: int = 100, seed: int = 42) -> DataFrame:
    """(n, ef, build_s, exact_us, approximate_us, recall, bytes, speedup): one graph a size, in one task after another so that times are
    a lone searcher's; medians are upper ones."""

    def run(it):
        for pdf in it:
            for n in pdf["n"]:
                v, asked = clustered(int(n), dim, seed), clustered(questions, dim, seed, 10**9)
                began, g = time.perf_counter(), Graph(dim, m, effort, seed)
                for i, x in enumerate(v):
                    g.add(i, x)
                built, exact, slow = time.perf_counter() - began, [], []
                for q in asked:
                    at = time.perf_counter()
                    d = v @ q
                    best = np.argpartition(-d, min(k, len(d)) - 1)[:k]
                    slow.append(time.perf_counter() - at)
                    exact.append(set(best.tolist()))
                for ef in efs:
                    fast, hits = [], 0
                    for q, want in zip(asked, exact, strict=True):
                        at = time.perf_counter()
                        got = g.search(q, k, ef)
                        fast.append(time.perf_counter() - at)
                        hits += len(want & {i for _, i in got})
                    a, b = sorted(slow)[len(slow) // 2], sorted(fast)[len(fast) // 2]
                    yield pd.DataFrame([(int(n), ef, built, a * 1e6, b * 1e6, hits / (k * questions), g.bytes(), a / b)], columns=["n", "ef", "build_s", "exact_us", "approximate_us", "recall", "bytes", "speedup"])

    rows = spark.createDataFrame([(int(n),) for n in sizes], "n long").coalesce(1)
    return rows.mapInPandas(run, "n long, ef int, build_s double, exact_us double, approximate_us double, recall double, bytes long, speedup double")


def crossover(swept: DataFrame) -> DataFrame:
    """(ef, n): the smallest size at which the graph is faster than the plain search; none, no row."""
    return swept.where("speedup > 1").groupBy("ef").agg(F.min("n").alias("n"))
