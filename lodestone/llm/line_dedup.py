"""Line dedup: windows of three consecutive lines that occurred before are removed.

A window is three lines that follow one another (texts split at ``\\n``), compared as they stand, if at least one of them
has a word. Of all occurrences of a window the first (by doc_id, then line) stays; each line that a later occurrence
covers goes, overlaps merged. Windows are judged on the input, not on what is left.

Windows travel as 128-bit hashes. First occurrences come from a partially aggregated minimum; only windows that occur
more than once are joined back, from a written table, so that adaptive execution can split a window that a third of all
documents share. Positions then meet their text by document.

Edge cases: null text stays null (no lines); an empty text is one empty line; under three lines there is no window. Rows
that share doc_id and text are one document and get the same answer; a null doc_id sorts first. Other columns pass
through, and a clashing one is replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WORD, cut, map_chunks, with_columns

ORACLE = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, p, ls[p] || chr(10) || ls[p + 1] || chr(10) || ls[p + 2] AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM l WHERE len(ls) >= 3)),
d AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n
      FROM w WHERE regexp_matches(k, '[^\x20\x09-\x0D]')) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, p + o AS p FROM d, (SELECT unnest([0, 1, 2]) AS o)),
x AS (SELECT l.doc_id, t.p, l.ls[t.p] AS line, c.p IS NOT NULL AS gone
      FROM l, LATERAL (SELECT unnest(range(1, len(l.ls) + 1)) AS p) t LEFT JOIN c ON c.doc_id = l.doc_id AND c.p = t.p),
y AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM x),
z AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans,
      coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS kept FROM y GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN z ON z.doc_id = documents.doc_id
"""


def apply_windows(texts: list[bytes], starts: pa.Array, nulls: pa.Array) -> dict:
    """The texts without the lines of the windows that begin at starts (lists of line numbers)."""
    out: dict[str, list] = {"text": [], "n_lines": [], "n_removed": [], "n_spans": []}
    for text, at, null in zip(texts, starts.to_pylist(), nulls.to_pylist(), strict=True):
        lines = [] if null else text.split(b"\n")
        gone = np.zeros(len(lines) + 1, bool)
        for k in range(3):
            gone[np.asarray(at or [], np.int64) + k] = True
        kept = [x for x, g in zip(lines, gone, strict=False) if not g] if at else lines
        out["text"].append(None if null else b"\n".join(kept).decode("utf-8", "replace"))
        out["n_lines"].append(len(lines))
        out["n_removed"].append(int(gone.sum()))
        out["n_spans"].append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with text shortened, and n_lines, n_removed, n_spans."""
    keyed = docs.withColumns({"__ld_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__ld_text": F.xxhash64("text")})
    lines = F.split("text", "\n", -1)
    one = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), x.rlike(WORD).alias("w")))  # each line is hashed once
    of = lambda i, c: [F.get(F.col("ls"), i + k)[c] for k in range(3)]
    keys = F.transform(F.sequence(F.lit(0), F.size("ls") - 3), lambda i: F.struct(F.xxhash64(*of(i, "a")).alias("a"), F.xxhash64(*of(i, "b")).alias("b"), reduce(or_, of(i, "w")).alias("w")))
    found = keyed.where(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) >= 2).select("__ld_id", "__ld_text", one.alias("ls"))
    found = found.select("__ld_id", "__ld_text", F.posexplode(keys).alias("p", "k")).where("k.w").select(F.col("k.a").alias("a"), F.col("k.b").alias("b"), F.struct("__ld_id", "__ld_text", "p").alias("at"))
    first = cut(found.groupBy("a", "b").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    later = found.join(first, ["a", "b"]).where("at <> first").select("at.*")
    later = later.groupBy("__ld_id", "__ld_text").agg(F.collect_set("p").alias("__ld_starts"))
    joined = keyed.join(later, ["__ld_id", "__ld_text"], "left").withColumn("__ld_null", F.col("text").isNull())
    keep = [c for c in docs.columns if c.lower() != "text"]
    out = map_chunks(joined, ["text", "__ld_starts", "__ld_null"], apply_windows, "text string, n_lines long, n_removed long, n_spans long", keep)
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed", "n_spans")]
    return out.select(*names, "n_lines", "n_removed", "n_spans")


def digest(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def shorten(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: the columns of docs, text without repeated windows and n_chars counted anew."""
    out = dedup_lines(docs).select(*docs.columns)
    return with_columns(out, {"n_chars": F.length("text").cast("long")}).select(*docs.columns) if "n_chars" in docs.columns else out
