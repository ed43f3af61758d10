"""Structure-aware chunking: one document is one sequential fold, documents run in parallel as Arrow batches."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import DEFAULTS, Settings
from lodestone.functions import text as T

#: The form of a heading; lines that close a block of code.
HEADING = re.compile(r"(#{1,6})\s+(.+?)\s*#*\Z")
CLOSERS = {"}", ")", "};", "):", "]"}


def pack(sentences: list[str], s: Settings = DEFAULTS) -> list[str]:
    """Sentences to chunks of about s.chunk_words; each next one starts with the last sentences of the one before."""
    chunks, held, words = [], [], 0
    for sentence in sentences:
        n = len(sentence.split())
        if n > s.chunk_words:
            chunks += [" ".join(held)] if held else []
            parts, held, words = sentence.split(), [], 0
            chunks += [" ".join(parts[i : i + s.chunk_words]) for i in range(0, n, s.chunk_words)]
            continue
        if held and words + n > s.chunk_words:
            chunks.append(" ".join(held))
            k, words = 1, len(held[-1].split())  # at least one sentence is carried over
            while k < len(held) and words + len(held[-k - 1].split()) <= s.overlap_words:
                k += 1
                words += len(held[-k].split())
            held = held[-k:]
        held.append(sentence)
        words += n
    return chunks + ([" ".join(held)] if held else [])


def sections(text: str) -> list[tuple[str, str]]:
    """(heading path, body) of a Markdown text; headings inside fences are text."""
    out, stack, body, fenced = [], [], [], False
    for line in [*text.split("\n"), None]:
        found = None
        if line is not None:
            if line.strip().startswith("```"):
                fenced = not fenced
            found = None if fenced else HEADING.match(line)
        if line is None or found:
            if "\n".join(body).strip():
                out.append((" > ".join(stack), "\n".join(body).strip()))
            body = []
        if found:
            level = len(found[1])
            stack = (stack + [""] * level)[: level - 1] + [found[2]]
        elif line is not None:
            body.append(line)
    return out


def top_level(line: str) -> bool:
    return bool(line) and line[0] not in " \t" and line.strip() not in CLOSERS


def code_chunks(text: str, s: Settings = DEFAULTS) -> list[str]:
    """Line ranges: a cut before a top-level line in the second half of a chunk, or an overlapping one when it is full."""
    lines, begin, cuts = text.split("\n"), 0, []
    for i, line in enumerate(lines):
        if top_level(line) and i - begin >= s.code_lines // 2:
            cuts.append((begin, i))
            begin = i
        elif i - begin >= s.code_lines:
            cuts.append((begin, i))
            begin = i - s.code_overlap
    bodies = ["\n".join(lines[a:b]).rstrip("\n") for a, b in [*cuts, (begin, len(lines))]]
    return [b for b in bodies if b.strip()]


def overlap(before: bytes, after: bytes, most: int = 4096) -> int:
    """The length of the longest end of one that the other begins with."""
    before = before[-most:]
    at = 0 if len(before) <= len(after) else len(before) - len(after)
    while not after.startswith(before[at:]):
        at = before.find(after[:1], at + 1)
        if at < 0:
            return 0
    return len(before) - at


def stitch(chunks: list[str]) -> str:
    """Chunks of one document back to a text; what a chunk repeats of the end of the one before counts once.

    A chunk that is nothing but such a repetition is left out, and the next one is compared with the one before it.
    """
    if not chunks:
        return ""
    texts = [c.encode() for c in chunks]
    out, last = [texts[0]], texts[0]
    for t in texts[1:]:
        n = overlap(last, t)
        if n < len(t):
            out += [b"\n\n" if not n else b"" if t[n : n + 1] == b" " or last.endswith(b" ") else b" ", t[n:]]
            last = t
    return b"".join(out).decode("utf-8", "replace")


#: Documents that one step of a task cuts at a time.
STEP = 64


def chunk(docs: DataFrame, s: Settings = DEFAULTS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, chunk_index, heading_path, text, error) of docs (id, text, content_type), and the columns ``carry`` of docs. A text over
    s.max_bytes is refused and a null one is none: each gives one row with an error and no text. An empty text gives no row.
    Refused texts do not leave the JVM, and texts are cut a few at a time, so a task holds one Arrow batch and the chunks of STEP documents."""
    size = F.octet_length("text")
    error = F.when(F.col("text").isNull(), "no text").when(size > s.max_bytes, f"over {s.max_bytes} bytes")
    read = docs.select("id", F.when(size <= s.max_bytes, F.col("text")).alias("__text"), F.coalesce("content_type", F.lit("")).alias("__kind"), error.alias("__error"), *carry)

    def cut(text: str | None, kind: str, error: str | None) -> list[tuple]:
        if error:
            return [(0, "", None, error)]
        if kind.startswith("code:"):
            found = [(kind[5:], c) for c in code_chunks(text, s)]
        elif kind == "markdown":
            found = [(h, f"{h}: {c}" if h else c) for h, body in sections(text) for c in pack(simple_sentences(body), s)]
        else:
            found = [("", c) for c in pack(simple_sentences(text), s)]
        return [(i, h, c, None) for i, (h, c) in enumerate(found)]

    def run(it):
        types = (pa.int32(), pa.string(), pa.string(), pa.string())
        for batch in it:
            for begin in range(0, batch.num_rows, STEP):
                b = batch.slice(begin, STEP)
                rows, of = [], []
                for i, parts in enumerate(zip(*(b[c].to_pylist() for c in ("__text", "__kind", "__error")), strict=True)):
                    got = cut(*parts)
                    rows += got
                    of += [i] * len(got)
                made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
                held = b.select(["id", *carry]).take(pa.array(of, pa.int64()))
                yield pa.RecordBatch.from_arrays([held["id"], *made, *[held[c] for c in carry]], ["id", "chunk_index", "heading_path", "text", "error", *carry])

    more = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return read.mapInArrow(run, "id long, chunk_index int, heading_path string, text string, error string" + more)


_ENDS = re.compile(r"[.!?]+")
_HELD = re.compile(rf"(?:\A|[ \t\n\r])(?i:{'|'.join(re.escape(a) for a in T.ABBREVIATIONS)}|[a-z])\Z")
_BEFORE = max(map(len, T.ABBREVIATIONS)) + 1
#: The characters of T.SPACES.
_EDGE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def simple_sentences(text: str) -> list[str]:
    """The sentence rule on a plain string, as the column expression has it: only the ends of words before full stops are looked at."""
    parts, at, n = [], 0, len(text)
    for m in _ENDS.finditer(text):
        begin, end = m.span()
        if end < n and text[end] not in " \t\n\r" or text[begin] == "." and _HELD.search(text[max(0, begin - _BEFORE) : begin]):
            continue
        parts.append(text[at:end])
        at = end
    parts.append(text[at:])
    if "\x01" in text or "\x02" in text:  # the marks of the column expression
        parts = "\x01".join(parts).replace("\x02", "").split("\x01")
    return [x for x in (p.strip(_EDGE) for p in parts) if x]
