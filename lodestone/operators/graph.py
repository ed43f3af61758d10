"""The similarity graph of documents: nodes, edges, bounded walks with their induced edges, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS
from lodestone.functions import text as T
from lodestone.operators.shared import kept


def nodes(chunks: DataFrame) -> DataFrame:
    """(id, doc_key, label, source, open, created_at, text, n_chunks): one row a document of chunks (id, text, source, origin,
    created_at), named by its first chunk; texts in order of id (a document's size is bounded when it is ingested)."""
    key = T.doc_key(F.col("source"), F.col("origin"), F.col("id"))
    rows = chunks.select("id", "text", "source", "origin", "created_at", key.alias("doc_key"))
    first = F.min_by(F.struct("text", "source", "origin"), "id").alias("f")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), "\n\n").alias("text")
    one = rows.groupBy("doc_key").agg(F.min("id").alias("id"), first, F.max("created_at").alias("created_at"), text, F.count(F.lit(1)).alias("n_chunks"))
    s, o = F.col("f.source"), F.col("f.origin")
    return one.select("id", "doc_key", T.graph_label(F.col("f.text"), s, o).alias("label"), s.alias("source"), T.openable(s, o).alias("open"), "created_at", "text", "n_chunks")


def project(edges: DataFrame, of: DataFrame, key: str = "doc_key") -> DataFrame:
    """Chunk edges to undirected document edges (a, b, distance): the least distance of each pair. of: id of a chunk and its document."""
    s, t = of.select(F.col("id").alias("source_id"), F.col(key).alias("s")), of.select(F.col("id").alias("target_id"), F.col(key).alias("t"))
    joined = edges.join(s, "source_id").join(t, "target_id").where("s <> t")
    return joined.groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.min("distance").alias("distance"))


def walk(edges: DataFrame, root, depth: int, most: int = DEFAULTS.max_depth) -> DataFrame:
    """(node, depth) within depth hops of root over undirected edges (a, b). Adjacency is written once; a hop is a join with the
    frontier alone."""
    both = kept(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    start = both.sparkSession.range(1).select(F.lit(root).cast(both.schema["a"].dataType).alias("node"), F.lit(0).alias("depth"))
    seen = start
    for d in range(1, max(0, min(depth, most)) + 1):
        front = seen.where(F.col("depth") == d - 1).select(F.col("node").alias("a"))
        new = both.join(front, "a").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        seen = kept(seen.union(new.select("node", F.lit(d).alias("depth"))))
    return seen


def neighbourhood(graph_nodes: DataFrame, edges: DataFrame, root: str, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within depth hops of the document ``root`` with their depth, and the edges (a, b, distance: documents) among them.
    A root that has no node is an error."""
    if graph_nodes.where(F.col("doc_key") == root).isEmpty():
        raise LookupError(f"{root!r} has no graph node")
    edges = kept(edges)  # the walk and the edges among its nodes read it
    seen = walk(edges, root, depth)
    inside = seen.select(F.col("node").alias("a"))
    found = graph_nodes.join(seen.withColumnRenamed("node", "doc_key"), "doc_key")
    return found, edges.join(inside, "a", "left_semi").join(inside.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b", "distance")


def neighbours_of(edges: DataFrame, node) -> DataFrame:
    """(node, neighbour, similarity) of one node, the most similar first."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("neighbour"), "distance").union(edges.select("b", "a", "distance"))
    return both.where(F.col("node") == node).select("node", "neighbour", (1 - F.col("distance")).alias("similarity")).orderBy(F.desc("similarity"), "neighbour")


def as_json(graph_nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One JSON text a node and an edge, with the field names of the graph view; edges name node ids."""
    made = graph_nodes.select(F.to_json(F.struct("id", F.col("doc_key").alias("key"), "label", "source", "open", F.col("created_at").alias("createdAt"), "text")).alias("json"))
    ids = graph_nodes.select("doc_key", "id")
    joined = edges.join(ids.select(F.col("doc_key").alias("a"), F.col("id").alias("source")), "a").join(ids.select(F.col("doc_key").alias("b"), F.col("id").alias("target")), "b")
    return made, joined.select(F.to_json(F.struct("source", "target", "distance")).alias("json"))
