"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage takes any table with doc_id and text: null and empty texts, very long ones, ties, repeated rows, an empty table
and further columns, whatever their names; all but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, langid, line_dedup, minhash, sentencepiece_codec
from lodestone.llm.common import cut, table
from lodestone.llm.queries import PIECES


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language can be given go: null and letterless texts, and texts whose n-grams the learned languages
    hardly have. Repeated rows stay or go together, texts count whole, nothing goes on account of lang; an empty table stays
    empty. With no labelled row to learn from, all documents go. Columns named like the operator's own pass through."""
    return langid.keep_known(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of three lines that occurred before (smaller doc_id, or above in the same text) go from the texts; n_chars is
    counted anew. Null texts stay null, texts under three lines stay, rows that share doc_id and text are one document, a null
    doc_id sorts first. Clashing columns pass through."""
    return line_dedup.shorten(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (shingles of five words, similarity of 0.8 or more), the one of the
    least doc_id. Null and wordless texts and rows without doc_id are linked with nothing and stay; repeated rows of the
    document that stays all stay. Clashing columns pass through."""
    return minhash.first_of_each(docs, 80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, with few edits, go. Null and empty texts stay; an empty benchmark keeps all;
    repeated rows stay or go together. Clashing columns pass through."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, checked to decode to it. Null and empty texts have none; a row for each row, texts whole.
    Returns doc_id, lang and source (as far as there are such columns), token_ids, n_tokens and round_trip."""
    out = sentencepiece_codec.transcode(docs, sentencepiece_codec.Vocabulary.load(PIECES), keep=[c for c in docs.columns if c.lower() in ("doc_id", "lang", "source")])
    return out.drop("decoded_text")


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", tokenise),
]

#: Language ID and the piece codec have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
