"""Files and pages as tables: extraction from bytes, and the snapshot store they end up in."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.config import DEFAULTS
from lodestone.functions import text as T


def docx_text(data: bytes) -> str:
    """The paragraphs of a word-processor file; empty if it holds none."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (KeyError, zipfile.BadZipFile, ElementTree.ParseError):
        return ""
    marks, out = {"tab": "\t", "br": "\n", "cr": "\n"}, []

    def visit(node) -> None:
        name = node.tag.rsplit("}", 1)[-1]
        out.append((node.text or "") if name == "t" else marks.get(name, ""))
        for child in node:
            visit(child)
        if name == "p":
            out.append("\n")

    visit(root)
    return "".join(out).strip()


@F.pandas_udf(StringType())
def _docx(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in it:
        yield batch.map(docx_text)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def extract(files: DataFrame, pdf=None) -> DataFrame:
    """(path, modificationTime, content_type, text, error) of files (path, content, modificationTime). pdf: a column function for
    PDF bytes; without it such files have an error and no text. Bytes that are no UTF-8 become U+FFFD."""
    ext, raw = T.extension(F.col("path")), F.make_valid_utf8(F.col("content").cast("string"))
    nul = F.instr(F.decode("content", "ISO-8859-1"), "\x00") > 0
    plain = F.when(F.length("content") < DEFAULTS.min_file_bytes, "").when(nul, "")
    text = (
        F.when(ext == ".docx", _docx("content")).when(ext == ".pdf", F.regexp_replace(pdf(F.col("content")), "\r\n", "\n") if pdf else F.lit(""))
        .when(plain.isNotNull(), plain).when(ext.isin(".md", ".markdown"), T.clean_markdown(raw)).when(ext.isin(".html", ".htm"), T.strip_html(raw)).otherwise(raw)
    )
    error = F.lit(None).cast("string") if pdf else F.lit("no function for PDF text was given")
    text = F.when(F.octet_length(text) < DEFAULTS.min_file_bytes, "").otherwise(text)
    return files.where(T.is_supported(F.col("path"))).select("path", "modificationTime", T.content_type(F.col("path")).alias("content_type"), text.alias("text"), F.when(ext == ".pdf", error).alias("error"))
