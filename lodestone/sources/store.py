"""The store: chunks, vectors, edges and document hashes as immutable snapshots of Parquet parts.

A version is a small JSON file that names the parts (folders of rows) and tombstones (folders of ids) of each table. Nothing is
written in place: an ingest adds parts, a deletion adds tombstones, and the file of the new version comes last, so a reader or a
crash in between sees the version before. ``compact`` rewrites the tables without what is gone. One writer at a time."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "chunks": "id long, text string, source string, origin string, created_at timestamp, heading_path string, chunk_index int, doc_title string, content_type string, doc_key string",
    "vectors": "id long, embedding array<float>",
    "relations": "source_id long, target_id long, distance double",
    "documents": "doc_key string, hash string, updated_at timestamp",
}
KEYS = {"chunks": ["id"], "vectors": ["id"], "relations": ["source_id", "target_id"], "documents": ["doc_key"]}
FORMAT = 2
#: What earlier formats lacked: (table, column, value for rows that have none).
MIGRATIONS = {1: [("chunks", "heading_path", ""), ("chunks", "chunk_index", 0), ("chunks", "doc_title", ""), ("chunks", "content_type", "")]}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        at = self._path(self.path)
        self.system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.system.mkdirs(self._path(f"{self.path}/versions"))

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.system.listStatus(self._path(f"{self.path}/versions"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def meta(self, version: int | None = None) -> dict:
        """What a version (the newest by default) consists of; an empty store has none."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "format": FORMAT, "next_id": 1, "tables": {t: [] for t in SCHEMAS}}
        text = self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, table: str, meta: dict | None = None) -> DataFrame:
        """A table of a version: its parts in turn, each without the keys that later tombstones name."""
        meta = meta or self.meta()
        out, parts = None, []
        for entry in meta["tables"][table]:
            if "rows" in entry:
                parts.append(entry["rows"])
                continue
            rows = self._rows(table, parts, meta["format"]) if parts else None
            out = rows if out is None else out if rows is None else out.unionByName(rows)
            parts = []
            if out is not None:
                out = out.join(self.spark.read.parquet(entry["gone"]), KEYS[table] if entry.get("by") is None else entry["by"], "left_anti")
        rows = self._rows(table, parts, meta["format"]) if parts else None
        out = rows if out is None else out if rows is None else out.unionByName(rows)
        return self.spark.createDataFrame([], SCHEMAS[table]) if out is None else out.select(*[c.split()[0] for c in SCHEMAS[table].split(", ")])

    def _rows(self, table: str, parts: list[str], version: int) -> DataFrame:
        df = self.spark.read.schema(SCHEMAS[table]).parquet(*parts)
        for before in range(version, FORMAT):
            for t, column, value in MIGRATIONS.get(before, []):
                if t == table:
                    df = df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))
        return df

    def part(self, df: DataFrame) -> str:
        """df as a new folder of the store."""
        at = f"{self.path}/parts/{uuid.uuid4().hex}"
        df.write.parquet(at)
        return at

    def commit(self, meta: dict, add: dict[str, DataFrame] | None = None, gone: dict[str, tuple[DataFrame, list[str]]] | None = None, **facts) -> int:
        """The next version: tombstones (keys by table) first, new rows after them, the version's file last."""
        tables = {t: list(entries) for t, entries in meta["tables"].items()}
        for table, (keys, by) in (gone or {}).items():
            tables[table].append({"gone": self.part(keys.select(*by).distinct()), "by": by})
        for table, rows in (add or {}).items():
            tables[table].append({"rows": self.part(rows.select(*[c.split()[0] for c in SCHEMAS[table].split(", ")]))})
        return self._publish({**meta, **facts, "tables": tables, "format": FORMAT})

    def _publish(self, meta: dict) -> int:
        version = max(self.versions(), default=0) + 1
        draft, final = self._path(f"{self.path}/versions/.{uuid.uuid4().hex}"), self._path(f"{self.path}/versions/{version}.json")
        out = self.system.create(draft, False)
        out.write(bytearray(json.dumps({**meta, "version": version}).encode()))
        out.close()
        if not self.system.rename(draft, final):
            raise RuntimeError(f"version {version} was written by another writer")
        return version

    def compact(self) -> int:
        """All tables as one part each, in the current format."""
        meta = self.meta()
        tables = {t: [{"rows": self.part(self.read(t, meta))}] for t in SCHEMAS}
        return self._publish({**meta, "tables": tables, "format": FORMAT})

    def clear(self) -> int:
        """An empty version; ids start anew."""
        return self._publish({"format": FORMAT, "next_id": 1, "tables": {t: [] for t in SCHEMAS}})

    def counts(self) -> DataFrame:
        """(chunks, vectors, relations, documents, format, mismatch) in one row."""
        meta = self.meta()
        rows = [self.read(t, meta).select(F.lit(t).alias("t")) for t in SCHEMAS]
        total = rows[0].union(rows[1]).union(rows[2]).union(rows[3]).agg(*[F.count(F.when(F.col("t") == t, 1)).alias(t) for t in SCHEMAS])
        return total.withColumns({"format": F.lit(meta["format"]), "mismatch": F.col("chunks") != F.col("vectors")})
