"""Continuous ingestion of a folder: new and edited files as micro-batches, replayed safely.

The built-in file stream remembers paths, not versions, so an edit would be lost. This source's offset is the latest time at which
a file was changed; a micro-batch is every file changed since the last one, named by the driver and read by tasks. A file that a batch names and that is
gone or has changed again when it is read comes with a later batch, if at all; ingestion skips what it has seen (by hash)."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from lodestone.knowledge import KnowledgeBase, pending

#: Files changed within this time are left for the next batch, as they may still be written.
SETTLE_NS = 50_000_000


class Share(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        self.paths = paths


class FolderReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.share, self.last = options["path"], int(options.get("share", 64)), 0

    def _files(self) -> list[tuple[str, int]]:
        """Paths and when they were changed (written, or put there)."""
        with os.scandir(self.path) as it:
            return sorted((e.path, e.stat().st_ctime_ns) for e in it if e.is_file() and not e.name.startswith("."))

    def initialOffset(self) -> dict:
        return {"upto": 0}

    def latestOffset(self) -> dict:
        settled = time.time_ns() - SETTLE_NS
        self.last = max([self.last, *(t + 1 for _, t in self._files() if t < settled)])
        return {"upto": self.last}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        new = [(p, t) for p, t in self._files() if start["upto"] <= t < end["upto"]]
        return [Share(new[i : i + self.share]) for i in range(0, len(new), self.share)] or [Share([])]

    def read(self, partition: Share):
        for path, version in partition.paths:
            try:
                with open(path, "rb") as f:
                    yield (path, version, bytearray(f.read()))
            except FileNotFoundError:
                continue


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone_folder"

    def schema(self) -> str:
        return "path string, version long, content binary"

    def streamReader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def watch(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.readStream.format("lodestone_folder").option("path", path).load()


def ingest(stream: DataFrame, knowledge: KnowledgeBase, checkpoint: str, claims: str | None = None, pdf=None, **trigger) -> StreamingQuery:
    """Ingest a stream of files into a knowledge base. claims: a table of paths whose next appearance another way has taken already.
    Of several versions of a path in a batch the newest counts; a batch that is replayed changes nothing."""
    spark = stream.sparkSession

    def batch(df: DataFrame, number: int) -> None:
        found = df.groupBy("path").agg(F.max_by(F.struct("content", "version"), "version").alias("f")).select("path", "f.*")
        if claims and knowledge.store.system.exists(knowledge.store._path(claims)):
            found = pending(found, spark.read.parquet(claims))
        knowledge.add_files(found.select("path", "content", F.timestamp_micros((F.col("version") / 1000).cast("long")).alias("modificationTime")), pdf)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
