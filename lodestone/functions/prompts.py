"""Prompts as expressions; the wording is this engine's own, the replies' forms are what functions.text parses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T


def head(x: Column, n: int) -> Column:
    """The first n bytes of a text, marked if there are more; a character cut in two becomes U+FFFD."""
    cut = F.make_valid_utf8(F.substring(F.encode(x, "UTF-8"), 1, n).cast("string"))
    return F.when(F.octet_length(x) > n, F.concat(cut, F.lit("..."))).otherwise(x)


def snippets(passages: Column, n: int) -> Column:
    """Numbered passages (an array of texts) on one line each, n bytes of each."""
    one = lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.replace(head(x, n), F.lit("\n"), F.lit(" ")))
    return F.array_join(F.transform(passages, one), "\n")


def rewrite(question: Column) -> Column:
    return F.concat(F.lit("Split the question into the separate searches that answer it, one a line, at most four, each complete in itself.\nquestion: "), question, F.lit("\nLOOKUPS:\n"))


def rerank(question: Column, passages: Column) -> Column:
    ask = F.lit("Order the passages by how well they answer the question. Reply with their numbers alone, the best first, separated by commas.\nquestion: ")
    return F.concat(ask, question, F.lit("\n\n"), snippets(passages, 400), F.lit("\n\nORDER:"))


def verdict(claim: Column, passages: Column) -> Column:
    ask = F.lit("Which passage states or directly implies the claim? Reply with its number alone, or NONE.\n\n")
    return F.concat(ask, snippets(passages, 600), F.lit("\n\nclaim: "), claim, F.lit("\nANSWER:"))


RULES = (
    "Use the passages below and nothing else.",
    "What is not in them is not known: no names, dates or figures from elsewhere.",
    "If they do not answer the question, say what they do cover and that the rest is not among the saved documents.",
    "Give the answer first, in few words, with the details it rests on.",
    "Do not repeat the question or offer further help.",
)


def answer(question: Column, passages: Column, date: Column, source: Column) -> Column:
    """passages: array of structs (text, doc_title, source, origin, heading_path, created_at), the best first. date, source: flags."""
    rules = F.lit("\n".join(f"{i}. {r}" for i, r in enumerate(RULES, 1)))
    cited = F.array_join(F.array_compact(F.array(F.when(source, "its document"), F.when(date, "the day it was saved"))), " and ")
    extra = F.when(date | source, F.concat(F.lit("\n6. Name "), cited, F.lit(" once, in brackets, where you use a passage."))).otherwise("")
    label = lambda p: T.chunk_label(p["doc_title"], p["source"], p["origin"])
    documents = manifest(passages)
    listed = F.array_join(F.transform(documents, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x)), "\n")
    section = lambda p: F.when(p["heading_path"] != "", F.concat(F.lit(" | section: "), p["heading_path"])).otherwise("")
    one = lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] document: "), label(p), section(p), F.lit(" | saved: "), F.coalesce(F.date_format(p["created_at"], "yyyy-MM-dd"), F.lit("")), F.lit("\n"), p["text"])
    return F.concat(
        F.lit("You answer from the user's own saved documents.\n"), rules, extra, F.lit("\n\nDOCUMENTS ("), F.size(documents).cast("string"), F.lit("):\n"), listed,
        F.lit("\n\nPASSAGES:\n"), F.array_join(F.transform(passages, one), "\n\n"), F.lit("\n\nQUESTION: "), question, F.lit("\nOnly the passages count; what they lack, say so.\nANSWER:"),
    )


def manifest(passages: Column) -> Column:
    """The different documents of passages, in the order of their first one."""
    return F.array_distinct(F.filter(F.transform(passages, lambda p: T.chunk_label(p["doc_title"], p["source"], p["origin"])), lambda x: x != ""))


def without_context(question: Column) -> Column:
    return F.concat(F.lit('No saved document matches the question. Answer from general knowledge and begin with "[outside knowledge]: ".\n\nQUESTION: '), question)


def grounding(checked: Column, supported: Column, unsupported: Column) -> Column:
    """The report under an answer: nothing if no claim was checked. unsupported: array of claims."""
    percent = F.bround(100.0 * supported / F.when(checked > 0, checked), 0)
    share = F.format_string("\n--- grounding: %.0f%% (%d/%d claims supported)", percent, supported, checked)
    lines = F.array_join(F.transform(unsupported, lambda c: F.concat(F.lit("  ! not in your documents: "), head(c, 120), F.lit("\n"))), "")
    return F.when(checked == 0, "").otherwise(F.concat(share, F.when(F.size(unsupported) == 0, " ---\n").otherwise(F.concat(F.format_string(", %d unsupported ---\n", F.size(unsupported)), lines))))
