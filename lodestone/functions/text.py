"""Scalar expressions over text, names and identities; all of them native."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\x{85}\p{Z}]"

#: Words that end in a full stop without ending a sentence.
ABBREVIATIONS = (
    "mr", "mrs", "ms", "dr", "prof", "st", "fig", "figs", "eq", "eqs", "ref", "refs", "sec", "ch", "vol", "no", "pp", "al", "e.g", "i.e", "vs",
    "etc", "cf", "approx", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)
#: Words that a keyword query leaves out.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "than", "that", "this", "these", "those", "is", "are", "was", "were", "be", "been",
    "being", "am", "do", "does", "did", "have", "has", "had", "can", "could", "will", "would", "should", "may", "might", "must", "i", "me",
    "my", "you", "your", "it", "its", "we", "our", "they", "them", "their", "he", "she", "his", "her", "of", "in", "on", "at", "to", "for",
    "with", "from", "by", "about", "as", "into", "what", "when", "where", "who", "whom", "which", "why", "how", "there", "here", "me?",
    "please", "tell", "show", "give",
)
#: Code:<language> by file ending.
LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".c": "c", ".cpp": "cpp", ".rs": "rust",
    ".sh": "shell", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".tex": "latex",
}
#: File endings that can be ingested.
SUPPORTED = (
    ".md", ".markdown", ".txt", ".html", ".htm", ".pdf", ".go", ".py", ".js", ".ts", ".java", ".c", ".cpp", ".rs", ".sh", ".json",
    ".yaml", ".yml", ".toml", ".csv", ".tsv", ".org", ".rst", ".tex", ".log", ".docx",
)
#: Marks of a question in several parts; marks of a hedge.
SEVERAL = (" and ", " also ", " as well as ", " plus ", " compare ", " versus ", " vs ", " difference between ")
HEDGES = (
    "i couldn't find", "i could not find", "i don't have", "i do not have", "the context does not", "the context doesn't", "there is no mention",
    "not mentioned", "the notes do not", "the notes don't", "no information", "is not in", "unfortunately",
)


def trim(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{SPACES}+|{SPACES}+\z", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin(*SUPPORTED)


def content_type(path: Column) -> Column:
    ext, known = extension(path), F.create_map(*[F.lit(x) for k, v in LANGUAGES.items() for x in (k, v)])
    return F.when(ext.isin(".md", ".markdown"), "markdown").otherwise(F.coalesce(F.concat(F.lit("code:"), F.try_element_at(known, ext)), F.lit("text")))


def strip_html(html: Column) -> Column:
    out = F.regexp_replace(html, r"<[^>]+>", "")
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


#: Markdown noise in the order it goes, and what stays of it.
MARKDOWN = (
    (r"`([^`]+)`", "$1"), (r"(?d)!\[.*?\]\(.*?\)", ""), (r"(?d)\[(.+?)\]\(.*?\)", "$1"), (r"(?d)\*\*(.+?)\*\*", "$1"), (r"(?d)__(.+?)__", "$1"),
    (r"(?d)\*(.+?)\*", "$1"), (r"(?d)_(.+?)_", "$1"), (r"(?s)\$\$(.+?)\$\$", "$1"), (r"(?d)\$(.+?)\$", "$1"), (r"(?dm)^[-*]{3,}[ \t\n\f\r]*$", ""),
)


def clean_markdown(text: Column) -> Column:
    for pattern, to in MARKDOWN:
        text = F.regexp_replace(text, pattern, to)
    return text


def is_web(x: Column) -> Column:
    return x.startswith("http://") | x.startswith("https://")


def is_linkable(x: Column) -> Column:
    return x.startswith("/") | is_web(x)


def doc_title(source: Column, origin: Column) -> Column:
    return F.when(is_web(origin), source).when(source.startswith("/"), basename(source)).otherwise("")


def chunk_label(title: Column, source: Column, origin: Column) -> Column:
    return F.when(title != "", title).when(origin != "", origin).otherwise(basename(source))


def openable(source: Column, origin: Column) -> Column:
    return F.when(origin != "", origin).when(source.startswith("/") | source.startswith("http"), source).otherwise("")


def safe_name(x: Column) -> Column:
    """A title as a file name: no slashes, 60 characters."""
    name = F.left(trim(F.translate(x, "/\\", "--")), F.lit(60))
    return F.when(name == "", "untitled").otherwise(name)


def stub(text: Column, source: Column, origin: Column) -> Column:
    """(name, body) of the readable copy of a text that no file holds: a note is named by its first 20 bytes."""
    web = F.struct(F.concat(safe_name(source), F.lit(".txt")).alias("name"), F.concat(F.lit("Title: "), source, F.lit("\nSource: "), origin, F.lit("\n\n"), text).alias("body"))
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, 20).cast("string"))
    return F.when(is_web(origin), web).otherwise(F.struct(F.concat(safe_name(head), F.lit(".txt")).alias("name"), text.alias("body")))


def query_flags(question: Column) -> Column:
    """The question without its flags, and which of them it had."""
    f = fields(question)
    rest = F.array_join(F.filter(f, lambda w: ~w.isin("--date", "--source")), " ")
    return F.struct(rest.alias("question"), F.array_contains(f, "--date").alias("date"), F.array_contains(f, "--source").alias("source"))


def found_in(needle: Column, *haystack: Column) -> Column:
    """Whether one of the texts contains the needle, whatever the case."""
    return F.contains(F.lower(F.concat_ws("\n", *haystack)), F.lower(needle))


def doc_key(source: Column, origin: Column, id: Column) -> Column:
    named = source.startswith("/") | source.startswith("http")
    return F.when(origin != "", origin).when(named, source).otherwise(F.concat(F.lit("chunk:"), id.cast("string")))


def replaceable(source: Column, origin: Column) -> Column:
    return (origin != "") | source.startswith("/") | source.startswith("http")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def doc_format(key: Column, source: Column, origin: Column) -> Column:
    ext = extension(F.when(origin.startswith("/"), origin).otherwise(source))
    web = origin.startswith("http") | source.startswith("http")
    return F.when(key.startswith("chunk:"), "note").when(web, "web").when(F.length(ext) > 1, F.substring(ext, 2, 100)).otherwise("text")


def graph_label(text: Column, source: Column, origin: Column) -> Column:
    host = F.regexp_extract(origin, r"^[^:]+://([^/?#]*)", 1)
    note = F.when(F.length(text) > 50, F.concat(F.left(text, F.lit(50)), F.lit("..."))).otherwise(text)
    path = F.when(origin.startswith("/"), origin).otherwise(source)
    two = F.regexp_extract(path, r"([^/]*/?[^/]+)/*\z", 1)
    web = F.when((source != "") & ~source.startswith("http"), source).when(host != "", host)
    return F.coalesce(F.when(origin.startswith("http"), web), F.when(path.startswith("/"), two), note)


def truncate(x: Column, n: int) -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("\n\n[truncated]"))).otherwise(x)


def sentences(text: Column) -> Column:
    abbr = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + "|[a-z]"
    for _ in (0, 1):  # neighbouring initials share the space between them
        text = F.regexp_replace(text, rf"(^|[ \t\n\r])((?i:{abbr}))(\.[.!?]*)([ \t\n\r]|\z)", "$1$2$3\x02$4")
    text = F.regexp_replace(text, r"([.!?]+)([ \t\n\r]|\z)", "$1\x01$2")
    parts = F.transform(F.split(F.replace(text, F.lit("\x02"), F.lit("")), "\x01"), trim)
    return F.filter(parts, lambda x: x != "")


def claims(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, r"([.!?]+)([ \t\n\r]|\z)|\n", "$1\x01"), "\x01")
    return F.filter(F.transform(parts, trim), lambda x: F.octet_length(x) > 2)


def is_factual(claim: Column) -> Column:
    low, out = F.lower(claim), (F.octet_length(claim) >= 15) & ~claim.endswith("?")
    for h in HEDGES:
        out = out & ~low.contains(h)
    return out


def fields(text: Column) -> Column:
    return F.filter(F.split(text, rf"{SPACES}+"), lambda x: x != "")


def query_terms(question: Column) -> Column:
    bare = lambda w: F.lower(F.regexp_replace(w, r"""^[.,!?;:'"()\[\]{}]+|[.,!?;:'"()\[\]{}]+\z""", ""))
    return F.filter(fields(question), lambda w: (bare(w) != "") & ~bare(w).isin(*STOPWORDS))


def fts_query(question: Column) -> Column:
    return F.array_join(F.transform(query_terms(question), lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def needs_decomposition(question: Column) -> Column:
    low = F.lower(question)
    out = (F.regexp_count(question, F.lit(r"\?")) > 1) | (F.size(fields(question)) > 25)
    for m in SEVERAL:
        out = out | low.contains(m)
    return out


def lookups(reply: Column) -> Column:
    """Sub-queries of a model's reply: lines without bullets, numbers and headings."""
    bare = F.transform(F.split(reply, "\n"), lambda x: trim(F.regexp_replace(trim(x), r"^([-*]|[0-9]+[.)])[ \t]*", "")))
    return F.filter(bare, lambda x: (F.octet_length(x) >= 3) & ~F.upper(x).startswith("LOOKUPS:") & ~F.lower(x).startswith("question:") & ~x.endswith(":"))


def verdict(reply: Column, n: Column) -> Column:
    found = F.regexp_extract(reply, "([0-9]+)", 1)
    value = F.coalesce(found.try_cast("int"), F.lit(0))
    return F.when(F.upper(trim(reply)).startswith("NONE") | (value < 1) | (value > n), 0).otherwise(value)


def rerank_order(reply: Column, n: Column) -> Column:
    zero = F.transform(F.regexp_extract_all(reply, F.lit("([0-9]+)"), F.lit(1)), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)) - 1)
    return F.array_distinct(F.filter(zero, lambda i: (i >= 0) & (i < n)))


def delete_spec(spec: Column) -> Column:
    """'1,5,9-7' to the distinct ids in order; null if it is not such a list."""
    parts = F.transform(F.split(F.regexp_replace(spec, " ", ""), ","), lambda p: F.transform(F.split(p, "-"), lambda x: x.try_cast("long")))
    ids = F.flatten(F.transform(parts, lambda r: F.sequence(F.least(r[0], F.element_at(r, -1)), F.greatest(r[0], F.element_at(r, -1)))))
    return F.when(F.regexp_replace(spec, " ", "").rlike(r"^[0-9]+(-[0-9]+)?(,[0-9]+(-[0-9]+)?)*\z"), F.array_distinct(ids))


def context_window(text: Column, headroom: int = 1024) -> Column:
    return F.greatest(F.lit(4096), F.least(F.lit(32768), F.floor(F.octet_length(text) / 3) + headroom)).cast("int")


def _folds() -> tuple[str, str]:
    """Latin letters with marks and the letters they are without them."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if c.islower() and len(unicodedata.normalize("NFD", c)) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLDS = _folds()


def fold(text: Column) -> Column:
    """Lower case, without marks on Latin letters (standing apart or not)."""
    return F.translate(F.regexp_replace(F.lower(text), r"[\x{300}-\x{36F}]", ""), *FOLDS)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def plain_tokens(text: Column) -> Column:
    """Tokens without marks, not yet stemmed."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
