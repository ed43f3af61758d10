"""Documents as a whole: which one an identifier means, its chunks back to a text, its facts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.config import DEFAULTS
from lodestone.functions import text as T
from lodestone.operators import chunking


@F.pandas_udf(StringType())
def stitched(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts of one document's chunks (an array, in reading order) as one text."""
    for batch in it:
        yield batch.map(lambda parts: chunking.stitch(list(parts)))


def key_of() -> Column:
    return T.doc_key(F.col("source"), F.col("origin"), F.col("id"))


def resolve(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(identifier, doc_key) of each identifier (wanted: a column identifier) that means a document.

    A number or chunk:number is a chunk's id and nothing else. Anything else is first an origin, then a source, then the end of
    either (whatever the case; % and _ stand for any characters, as in LIKE), each time the chunk of least id.
    Exact forms are equi-joins; the end of a name is a nested loop over the identifiers left over."""
    asked = wanted.select("identifier", T.trim(F.col("identifier")).alias("name")).where("name <> ''").distinct()
    number = F.regexp_replace("name", "^chunk:", "").try_cast("long")
    asked = asked.withColumn("number", number)
    c = chunks.select("id", "source", "origin")
    by_id = asked.where("number IS NOT NULL").join(c, F.col("number") == F.col("id")).select("identifier", F.lit(0).alias("way"), "id", "source", "origin")
    names = asked.where("number IS NULL")
    by_origin = names.join(c, F.col("name") == F.col("origin")).select("identifier", F.lit(1).alias("way"), "id", "source", "origin")
    by_source = names.join(c, F.col("name") == F.col("source")).select("identifier", F.lit(2).alias("way"), "id", "source", "origin")
    exact = by_id.union(by_origin).union(by_source)
    rest = names.join(exact.select("identifier").distinct(), "identifier", "left_anti")
    like = F.concat(F.lit("%"), F.lower(F.replace("name", F.lit("\\"), F.lit("\\\\"))))
    names_of = c.groupBy("source", "origin").agg(F.min("id").alias("id"))
    by_end = rest.withColumn("like", like).join(names_of, F.expr("lower(source) LIKE like OR lower(origin) LIKE like")).select("identifier", F.lit(3).alias("way"), "id", "source", "origin")
    first = exact.union(by_end).groupBy("identifier").agg(F.min_by(F.struct("id", "source", "origin"), F.struct("way", "id")).alias("c"))
    return first.select("identifier", T.doc_key(F.col("c.source"), F.col("c.origin"), F.col("c.id")).alias("doc_key"))


def fetch(chunks: DataFrame, keys: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """(doc_key, label, source, origin, open, format, text, chunk_ids, saved_at, hash, ingested_at) of documents (keys: doc_key).

    Chunks stand in the order of chunk_index and id; meta (doc_key, hash, updated_at) is joined if it has the document, else hash
    is empty. Keys without a chunk have no row."""
    rows = chunks.withColumn("doc_key", key_of()).join(keys.select("doc_key").distinct(), "doc_key", "left_semi")
    order = F.array_sort(F.collect_list(F.struct("chunk_index", "id", "text", "source", "origin"))).alias("c")  # one document, bounded at ingestion
    one = rows.groupBy("doc_key").agg(order, F.max("created_at").alias("saved_at"))
    s, o, first = F.col("c")[0]["source"], F.col("c")[0]["origin"], F.col("c")[0]["text"]
    texts = F.transform("c", lambda x: x["text"])
    out = one.select(
        "doc_key", T.graph_label(first, s, o).alias("label"), s.alias("source"), o.alias("origin"), T.openable(s, o).alias("open"), T.doc_format(F.col("doc_key"), s, o).alias("format"),
        stitched(texts).alias("text"), F.transform("c", lambda x: x["id"]).alias("chunk_ids"), "saved_at",
    )
    if meta is None:
        return out.withColumns({"hash": F.lit(""), "ingested_at": F.lit(None).cast("timestamp")})
    facts = meta.select("doc_key", F.col("hash"), F.col("updated_at").alias("ingested_at"))
    return out.join(facts, "doc_key", "left").withColumn("hash", F.coalesce("hash", F.lit("")))


def stamp(x: Column) -> Column:
    return F.coalesce(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def payload(found: DataFrame, files: DataFrame | None = None, most: int = DEFAULTS.document_chars) -> DataFrame:
    """fetch()'s rows as the API gives them. files (path, text, length, modificationTime): what stands in the document's file now,
    preferred to the stitched chunks where it has a text."""
    if files is None:
        named = found.withColumns({"__now": F.lit(None).cast("string"), "__size": F.lit(0).cast("long"), "__at": F.lit(None).cast("timestamp")})
    else:
        f = files.select(F.col("path").alias("__path"), F.col("text").alias("__now"), F.col("length").alias("__size"), F.col("modificationTime").alias("__at"))
        bare = f.withColumn("__path", F.regexp_replace("__path", "^file:/*", "/"))
        held = found.join(bare.select("__path").distinct().withColumn("__has", F.lit(True)), F.col("source") == F.col("__path"), "left").drop("__path")
        held = held.withColumn("__want", F.when(F.col("__has"), F.col("source")).otherwise(F.col("origin"))).drop("__has")
        named = held.join(bare, F.col("__want") == F.col("__path"), "left").drop("__path", "__want")
    whole = F.when(F.coalesce("__now", F.lit("")) != "", F.col("__now")).otherwise(F.col("text"))
    return named.select(
        F.col("doc_key").alias("document_id"), "label", F.col("open").alias("path"), "format", T.truncate(whole, most).alias("content"),
        F.when(F.coalesce("__now", F.lit("")) != "", "file").otherwise("chunks").alias("content_source"), (F.length(whole) > most).alias("truncated"),
        F.size("chunk_ids").alias("chunk_count"), "chunk_ids", F.col("hash").alias("ingestion_hash"), stamp(F.col("ingested_at")).alias("ingested_at"),
        stamp(F.col("saved_at")).alias("saved_at"), stamp(F.col("__at")).alias("last_modified"), F.coalesce("__size", F.lit(0)).alias("size_bytes"),
    )
