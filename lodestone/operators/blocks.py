"""Vectors as plain files in the shared folder, so that a block of queries can pass all of them without a shuffle.

A row goes to disk once; tasks read the files in turn, a chunk at a time, so neither memory nor what is written grows with the
number of pairs. The folder of spark.checkpoint.dir must be mounted on all machines."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.operators.shared import folder


class Chunk(NamedTuple):
    """Rows of one file: ids (ascending), then vectors."""

    path: str
    rows: int
    dim: int
    first: int
    last: int

    def read(self, begin: int = 0, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        n = (self.rows if end is None else min(end, self.rows)) - begin
        ids = np.fromfile(self.path, np.int64, n, offset=8 * begin)
        return ids, np.fromfile(self.path, np.float32, n * self.dim, offset=8 * self.rows + 4 * self.dim * begin).reshape(n, self.dim)


def place(spark) -> str:
    at = folder(spark).removeprefix("file://")
    if "://" in at:
        raise ValueError("spark.checkpoint.dir must be a mounted folder for searches over vectors")
    return at.removeprefix("file:")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of equally long lists as rows of single precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        raise ValueError("a vector is null")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), -1)


def put(at: str, ids: np.ndarray, v: np.ndarray) -> Chunk:
    """Rows in order of their ids as a new file, which has its name only once it is whole."""
    order, path = np.argsort(ids, kind="stable"), f"{at}/{uuid.uuid4().hex}.vec"
    ids, v = ids[order].astype(np.int64, copy=False), np.ascontiguousarray(v[order], np.float32)
    with open(f"{path}.part", "wb") as f:
        ids.tofile(f)
        v.tofile(f)
    os.rename(f"{path}.part", path)
    return Chunk(path, len(ids), v.shape[1], int(ids[0]), int(ids[-1]))


SCHEMA = "path string, rows long, dim int, first long, last long"


def rows_of(chunks: list[Chunk]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([c._asdict() for c in chunks], pa.schema([("path", pa.string()), ("rows", pa.int64()), ("dim", pa.int32()), ("first", pa.int64()), ("last", pa.int64())]))


def store(vectors: DataFrame) -> list[Chunk]:
    """vectors (id, embedding) as chunks in order of their first ids; names alone come to the driver."""
    at = place(vectors.sparkSession)

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                yield rows_of([put(at, b["id"].to_numpy(zero_copy_only=False), matrix(b["embedding"]))])

    found = vectors.selectExpr("cast(id AS long) AS id", "embedding").mapInArrow(write, SCHEMA).collect()
    return sorted((Chunk(*r) for r in found), key=lambda c: (c.first, c.path))


def packed(chunks: list[Chunk], rows: int, after: int | None = None) -> list[list[tuple[Chunk, int, int]]]:
    """Slices (chunk, begin, end) in blocks of about ``rows`` rows, of greater ids than ``after``."""
    out, n = [], rows
    for c in chunks:
        if after is not None and c.last <= after:
            continue
        start = 0 if after is None or c.first > after else int(np.searchsorted(np.fromfile(c.path, np.int64, c.rows), after, "right"))
        for begin in range(start, c.rows, rows):
            end = min(begin + rows, c.rows)
            if n + end - begin > rows:
                out.append([])
                n = 0
            out[-1].append((c, begin, end))
            n += end - begin
    return out


def load(slices: list[tuple[Chunk, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    got = [c.read(a, b) for c, a, b in slices]
    return np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])


def each(spark, works: list, run, schema: str) -> DataFrame:
    """run(work), an iterator of record batches, in a task of its own for each of works."""

    def go(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in b["id"].to_pylist():
                yield from run(works[i])

    return spark.range(0, len(works), 1, max(1, len(works))).mapInArrow(go, schema)
