"""Retrieval quality: golden sets, recall and reciprocal ranks, hop slices, misses, baselines and their deltas."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, question, relevant, hops, note) of a JSON file {cases: [...]}; an empty set, question or list is an error."""
    schema = "cases array<struct<question:string,relevant:array<string>,hops:int,note:string>>"
    cases = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("cases").alias("query_id", "c")).select("query_id", "c.*")
    cases = cases.select(F.col("query_id").cast("long").alias("query_id"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("relevant", F.array().cast("array<string>")).alias("relevant"), F.coalesce("hops", F.lit(0)).alias("hops"), F.coalesce("note", F.lit("")).alias("note"))
    if cases.isEmpty():
        raise ValueError(f"{path} has no cases")
    bad = cases.where((F.trim("question") == "") | (F.size("relevant") == 0)).orderBy("query_id").first()
    if bad:
        raise ValueError(f"case {bad['query_id']} has no question" if not bad["question"].strip() else f"case {bad['query_id']} ({bad['question']!r}) lists nothing relevant")
    return cases


def evaluate(results: DataFrame, cases: DataFrame, ks=DEFAULTS.ks) -> DataFrame:
    """One row a case: first relevant rank (0: none) and recall at each k. results: query_id, rank, source; cases: query_id, relevant."""
    hit = results.join(cases.select("query_id", F.explode("relevant").alias("want")), "query_id").where(F.contains("source", "want"))
    firsts = hit.groupBy("query_id", "want").agg(F.min("rank").alias("r"))
    per = firsts.groupBy("query_id").agg(F.min("r").alias("first"), *[F.count(F.when(F.col("r") <= k, 1)).alias(f"h{k}") for k in ks])
    out = cases.join(per, "query_id", "left")
    return out.select("query_id", F.coalesce("first", F.lit(0)).alias("first_rank"), *[(F.coalesce(f"h{k}", F.lit(0)) / F.size("relevant")).alias(f"recall_{k}") for k in ks])


def summarise(results: DataFrame, by: list[str] | None = None, ks=DEFAULTS.ks) -> DataFrame:
    """Number of cases, mean recalls and mean reciprocal rank of evaluate()'s rows, in all or by columns that were joined to them."""
    mrr = F.avg(F.when(F.col("first_rank") > 0, 1 / F.col("first_rank")).otherwise(0.0))
    known = [k for k in ks if f"recall_{k}" in results.columns]
    return results.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("cases"), *[F.round(F.avg(f"recall_{k}"), 6).alias(f"recall_{k}") for k in known], F.round(mrr, 6).alias("mrr"))


def by_hops(results: DataFrame, cases: DataFrame, ks=DEFAULTS.ks) -> DataFrame:
    """summarise() of single-hop (hops up to 1) and multi-hop cases apart, from the stored results."""
    kind = F.when(F.col("hops") > 1, "multi-hop").otherwise("single-hop")
    return summarise(results.join(cases.select("query_id", kind.alias("slice")), "query_id"), ["slice"], ks)


def misses(results: DataFrame) -> DataFrame:
    """Cases nothing relevant was found for."""
    return results.where("first_rank = 0").select("query_id")


def run(cases: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], ks=DEFAULTS.ks) -> DataFrame:
    """evaluate() of a retriever, called once with all questions (query_id, text) and the deepest k; it returns (query_id, rank, source)."""
    return evaluate(retrieve(cases.select("query_id", F.col("question").alias("text")), max(ks)), cases, ks)


def time_each(cases: DataFrame, retrieve: Callable[[str, int], list[str]], k: int = 20) -> list[float]:
    """Seconds of a retriever for one question after another (a golden set is written by hand; its questions come to the driver)."""
    took = []
    for row in cases.select("question").toLocalIterator():
        began = time.perf_counter()
        retrieve(row["question"], k)
        took.append(time.perf_counter() - began)
    return took


def nearest_rank(values: list[float], p: float) -> float:
    return sorted(values)[int(p / 100 * (len(values) - 1))] if values else 0.0


def baseline(summary: DataFrame, seconds: list[float], label: str = "", ks=DEFAULTS.ks) -> dict:
    r = summary.first()
    recall = {str(k): r[f"recall_{k}"] for k in ks if f"recall_{k}" in summary.columns}
    stamp = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    return {"recall_at_k": recall, "mrr": r["mrr"], "case_count": r["cases"], "median_latency_ms": 1000 * nearest_rank(seconds, 50), "p95_latency_ms": 1000 * nearest_rank(seconds, 95), "generated_at": stamp, "label": label}


def save_baseline(path: str, numbers: dict) -> None:
    with open(path, "w") as f:
        json.dump(numbers, f, indent=2)
        f.write("\n")


def load_baseline(path: str) -> dict | None:
    """None if there is no such file."""
    if not os.path.exists(path):
        return None
    with open(path) as f:
        return json.load(f)


def deltas(spark: SparkSession, now: dict, before: dict | None) -> DataFrame:
    """(metric, value, baseline, delta): delta as text with its sign, a dash if under 0.0005 or without a baseline."""
    flat = lambda b: {**{f"recall@{k}": v for k, v in b["recall_at_k"].items()}, "MRR": b["mrr"], "p50 ms": b["median_latency_ms"], "p95 ms": b["p95_latency_ms"]}
    old = flat(before) if before else {}
    rows = [(i, k, float(v), float(old[k]) if k in old else None) for i, (k, v) in enumerate(flat(now).items())]
    df = spark.createDataFrame(rows, "i int, metric string, value double, baseline double")
    change = F.col("value") - F.col("baseline")
    return df.orderBy("i").select("metric", "value", "baseline", F.when(F.abs(change) >= 0.0005, F.format_string("%+.3f", change)).otherwise("-").alias("delta"))
