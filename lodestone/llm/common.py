"""What the training-data operators share: tables, lineage cuts, batching of texts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words are runs of anything but these six characters (what ``bytes.split()`` takes as white space).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one only where none is set and the master is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the application ends."""
    path = f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"
    if path not in _MARKED:
        _MARKED.add(path)
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(at)
        system.deleteOnExit(at)
    return path


_MARKED: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it again: the lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}.parquet"
    before = spark.conf.get(CLEANUP, None)
    try:
        if before is not None:  # shuffle files go as soon as the table stands
            spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if before is not None:
            spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_ld_path"] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing to come reads."""
    for t in tables:
        at = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.__dict__["_ld_path"])
        at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def with_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Add columns; a column of the same name (in any case) is replaced."""
    clash = {k.lower() for k in new}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in clash], *[v.alias(k) for k, v in new.items()])


def held_out(key: Column, modulus: int, rest: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % modulus == rest


def slices(lengths: np.ndarray, limit: int, rows: int = 1 << 30) -> Iterator[slice]:
    """Runs of at most ``rows`` rows and about ``limit`` units; a longer row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and (total + n > limit or i - start >= rows):
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield slice(start, len(lengths))


def as_bytes(texts: Iterable) -> list[bytes]:
    """UTF-8; null is empty, and what cannot be encoded is replaced."""
    return [x.encode("utf-8", "replace") if isinstance(x, str) else b"" for x in texts]


def map_chunks(df: DataFrame, inputs: list[str], f, fields: str, keep: list[str] | None = None, limit: int = 1 << 20, rows: int = 1 << 30) -> DataFrame:
    """The columns ``keep`` of df (all by default) and the new ``fields``, made by f for runs of at most ``rows`` rows and
    about ``limit`` bytes.

    f gets the first of ``inputs`` as a list of bytes (null: empty) and the others as Arrow arrays; it returns a dict of
    columns. Only the run in hand is turned into Python objects, and runs go out as they are made, so that a worker holds one
    run's work besides the Arrow batch it reads. A kept column named like a new one is replaced.
    """
    new = StructType.fromDDL(fields)
    names = {n.lower() for n in new.names}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    work = [f"__ld_in{i}" for i in range(len(inputs))]
    source = df.select(*[df[f"`{c}`"] for c in kept], *[df[f"`{c}`"].alias(w) for c, w in zip(inputs, work, strict=True)])
    schema = StructType([*[df.schema[c] for c in kept], *new.fields])
    arrow_new = to_arrow_schema(new)

    def run(it: Iterator) -> Iterator:
        for batch in it:
            texts = batch.column(len(kept))
            if not pa.types.is_binary(texts.type):
                texts = texts.cast(pa.binary())
            for s in slices(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), limit, rows):
                part = batch.slice(s.start, s.stop - s.start)
                out = f([x or b"" for x in texts[s].to_pylist()], *part.columns[len(kept) + 1 :])
                made = [v if isinstance(v, pa.Array) else pa.array(v, type=t.type, from_pandas=True) for t in arrow_new for v in (out[t.name],)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names=[*kept, *new.names])

    return source.mapInArrow(run, schema)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (Steele, Lea and Flood 2014)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def lookup(keys: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Index of each probe in the sorted keys, -1 where there is none."""
    if not len(keys):
        return np.full(probes.shape, -1, np.int64)
    at = np.searchsorted(keys, probes)
    at[at == len(keys)] = 0
    return np.where(keys[at] == probes, at, -1)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of ranges: start, start+1, ... of each count."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
