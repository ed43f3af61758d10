"""Quality rules: counted base rules, and bands on the perplexity of a character n-gram model.

The model is modified Kneser-Ney over characters within words, one for each value of ``lang`` (null is one too), of one
order whatever the corpus. Characters are coded as symbols of 6 bits without loss: a-z as one, other code points below
U+07C0 as two (block, place in it), the rest as four; so an n-gram of symbols is an integer, no two characters fold
together, and the order reaches over fewer characters outside a-z. Spark counts the n-grams of every word of every text
and works out the probabilities; lower orders count different left neighbours. The model grows with the corpus: its tables
are ranges of sorted keys, written by tasks as arrays into the shared folder, which must be mounted on all machines, and
mapped into memory by those who score. Only the ranges' first keys and file names come to the driver.

Bands: within a language, a document's logarithm of perplexity (over all its words) may lie ``LOW`` times the quartile
distance under the median or ``HIGH`` times above it; others are rejected. The mean over few words varies more, so under
``STEADY`` words the band widens by the root of STEADY / n_words. Medians and quartiles are over all documents
that pass the base rules.

Edge cases: a null or empty text has no words and fails the base rule of 20 words; a language in which nothing passes the
base rules has no band and rejects nothing; a corpus without words has an empty model (every perplexity null, nothing
rejected by a band). Equal rows get equal answers. Clashing columns are replaced.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import as_bytes, cut, lookup, map_chunks, scratch, splitmix

ORDER = 5
RANGE = 1_000_000  # about so many keys a file
LOW, HIGH, STEADY = 8.0, 8.0, 150
SYMBOLS = b"#*$%&|<>"
WINDOW = 8


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """The first symbol of each code point and how many it takes; a space stands for a word's edge, which is symbol 0."""
    c = np.arange(0x110000, dtype=np.int64)
    first, many = np.where(c < 0x7C0, 27 + (c >> 6), 58 + (c >> 18)), np.where(c < 0x7C0, 2, 4)
    first[ord("a") : ord("z") + 1], many[ord("a") : ord("z") + 1] = 1 + np.arange(26), 1
    first[ord(" ")], many[ord(" ")] = 0, ORDER - 1
    return first.astype(np.uint8), many.astype(np.uint8)


FIRST, MANY = _symbols()


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The key of order ORDER at each predicted symbol (a word's symbols and its end), its word's number, and whether it starts a character."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    text = b" " + b" ".join(words) + b" "
    code = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    many, space = MANY[code].astype(np.int64), code == ord(" ")
    at = np.cumsum(many) - many
    total = int(at[-1]) + 1  # the last edge needs no room after it
    symbols, real, starts = np.zeros(total, np.int64), np.ones(total, bool), np.zeros(total, bool)
    symbols[at], starts[at] = FIRST[code], True
    for k in range(1, ORDER - 1):
        real[at[:-1][space[:-1]] + k] = False
    two, four = np.flatnonzero((many == 2) & ~space), np.flatnonzero((many == 4) & ~space)
    symbols[at[two] + 1] = code[two] & 63
    for k in (1, 2, 3):
        symbols[at[four] + k] = code[four] >> 6 * (3 - k) & 63
    ends = np.zeros(total, bool)
    ends[at[space]] = True
    key = np.zeros(total - ORDER + 1, np.int64)
    for k in range(ORDER):
        key = key << 6 | symbols[k : total - ORDER + 1 + k]
    real, starts, ends = real[ORDER - 1 :], starts[ORDER - 1 :], ends[ORDER - 1 :]
    return key[real], (np.cumsum(ends) - ends)[real], starts[real]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of the highest order over all words of all texts; each task adds up its own first."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Counter] = {}

        def out(lang: int) -> pd.DataFrame:
            words = held.pop(lang)
            key, word, _ = grams_of(list(words))
            n = np.fromiter(words.values(), np.int64, len(words))
            keys, inverse = np.unique(key, return_inverse=True)
            return pd.DataFrame({"lang": np.int64(lang), "gram": keys, "n": np.bincount(inverse, weights=n[word], minlength=len(keys)).astype(np.int64)})

        size = 0
        for frame in it:
            for lang, text in zip(frame["lang"], as_bytes(frame["text"]), strict=True):
                words = held.setdefault(lang, Counter())
                size -= len(words)
                words.update(text.split())
                size += len(words)
                if size > 600_000:
                    yield from map(out, list(held))
                    size = 0
        yield from map(out, list(held))

    return docs.mapInPandas(count, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Sorted:
    """Keys in ranges of sorted arrays in files, with values, mapped into memory where they are looked up."""

    def __init__(self, ranges: list):
        ranges = sorted(ranges, key=lambda r: r["first"])
        self.first = np.array([r["first"] for r in ranges], np.int64)
        self.files, self.open = [(r["path"], r["rows"]) for r in ranges], {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def find(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which probes are there, and their values (0 where not)."""
        found, values = np.zeros(len(probes), bool), np.zeros(len(probes))
        ranges = np.searchsorted(self.first, probes, "right") - 1
        for i in np.unique(ranges[ranges >= 0]):
            if i not in self.open:
                path, n = self.files[i]
                self.open[i] = np.memmap(path, np.int64, "r", shape=n), np.memmap(path, np.float32, "r", 8 * n, n)
            keys, held = self.open[i]
            mine = np.flatnonzero(ranges == i)
            at = lookup(keys, probes[mine])
            found[mine], values[mine] = at >= 0, np.where(at >= 0, held[at], 0)
        return found, values


def write_sorted(table: DataFrame) -> Sorted:
    """Sort (key, value) over all tasks; each writes its range of keys as a file of the shared folder."""
    folder = scratch(table.sparkSession)
    if "://" in (folder := folder.removeprefix("file://")):
        raise ValueError(f"the model's arrays need a mounted folder, not {folder}")
    folder = folder.removeprefix("file:")

    def write(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, rows, path = None, 0, f"{folder}/{uuid.uuid4().hex}"
        os.makedirs(folder, exist_ok=True)
        with open(path + ".bin", "wb") as keys, open(path + ".values", "w+b") as values:
            for frame in it:
                if len(frame):
                    first, rows = int(frame["key"].iloc[0]) if first is None else first, rows + len(frame)
                    keys.write(frame["key"].to_numpy(np.int64).tobytes())
                    values.write(frame["value"].to_numpy(np.float32).tobytes())
            values.seek(0)
            while block := values.read(1 << 24):
                keys.write(block)
        os.remove(path + ".values")
        if rows:
            yield pd.DataFrame({"first": [first], "rows": [rows], "path": [path + ".bin"]})

    table = cut(table)
    parts = table.count() // RANGE + 1
    return Sorted(table.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInPandas(write, "first long, rows long, path string").collect())


class Model:
    """log-probabilities of (language, n-gram) of each order, and log back-off of contexts. Language numbers are in ``langs``."""

    def __init__(self, langs: DataFrame, probs: Sorted, backs: Sorted):
        self.langs, self.probs, self.backs = langs, probs, backs
        self.order = ORDER if probs.files else 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"langs": None}

    @staticmethod
    def key(n: int, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return lang << 40 | np.int64(n) << 36 | gram

    def logs(self, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """The log-probability of each n-gram's last symbol after the others."""
        out, todo = np.zeros(len(gram)), np.arange(len(gram))
        for n in range(self.order, 0, -1):
            g = gram[todo] & (1 << 6 * n) - 1
            found, values = self.probs.find(self.key(n, lang[todo], g))
            out[todo] += values
            todo, g = todo[~found], g[~found]
            if not len(todo):
                break
            out[todo] += self.backs.find(self.key(n, lang[todo], g >> 6))[1]
        out[todo] += np.log(1 / 64)
        return out


def number_langs(docs: DataFrame) -> DataFrame:
    """(__ld_name, __ld_lang): a number for each value of lang, null too; the commonest has 0."""
    found = docs.groupBy("lang").count()
    return cut(found.select(F.col("lang").alias("__ld_name"), (F.row_number().over(Window.orderBy(F.desc("count"), "lang")) - 1).cast("long").alias("__ld_lang")))


def with_number(docs: DataFrame, langs: DataFrame) -> DataFrame:
    """docs with __ld_lang; -1 for a language that is not in langs."""
    out = docs.join(F.broadcast(langs), docs["lang"].eqNullSafe(langs["__ld_name"]), "left").drop("__ld_name")
    return out.withColumn("__ld_lang", F.coalesce("__ld_lang", F.lit(-1).cast("long")))


def estimate(n: int, counts: DataFrame, lower: DataFrame | None) -> DataFrame:
    """(lang, gram, p, gamma) of order n from counts (raw at the top, left neighbours below) and p of the next lower order."""
    m = counts.groupBy("lang").agg(*[F.greatest(F.lit(1), F.count(F.when(F.col("n") == k, 1))).alias(f"m{k}") for k in (1, 2, 3, 4)])
    y = F.col("m1") / (F.col("m1") + 2 * F.col("m2"))
    off = [F.least(F.lit(most), F.greatest(F.lit(0.1), k - (k + 1) * y * F.col(f"m{k + 1}") / F.col(f"m{k}"))).alias(f"d{k}") for k, most in ((1, 0.95), (2, 1.9), (3, 2.9))]
    t = counts.join(F.broadcast(m.select("lang", *off)), "lang")
    t = t.select("lang", "gram", "n", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("off"), F.shiftright("gram", 6).alias("ctx"))
    after = Window.partitionBy("lang", "ctx")  # 64 rows at most
    t = t.withColumn("total", F.sum("n").over(after)).withColumn("gamma", F.sum("off").over(after) / F.col("total"))
    own = (F.col("n") - F.col("off")) / F.col("total")
    if lower is None:
        return t.select("lang", "gram", (own + F.col("gamma") / 64).alias("p"), "gamma")
    t = t.withColumn("low", F.col("gram").bitwiseAND((1 << 6 * (n - 1)) - 1))
    return t.join(lower.select("lang", F.col("gram").alias("low"), F.col("p").alias("below")), ["lang", "low"]).select("lang", "gram", (own + F.col("gamma") * F.col("below")).alias("p"), "gamma")


def fit(docs: DataFrame) -> Model:
    """Count over all documents and build the model as sorted files."""
    langs = number_langs(docs)
    tables = {ORDER: cut(count_grams(with_number(docs.select("lang", "text"), langs).select(F.col("__ld_lang").alias("lang"), "text")))}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = cut(tables[n + 1].groupBy("lang", F.col("gram").bitwiseAND((1 << 6 * n) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    lower, every = None, []
    for n in range(1, ORDER + 1):
        lower = cut(estimate(n, tables[n], lower))
        every.append((n, lower))

    def keyed(table: DataFrame, n: int, gram, value: str) -> DataFrame:
        return table.select((F.shiftleft("lang", 40) + F.lit(n << 36) + gram).alias("key"), F.log(value).cast("float").alias("value"))

    probs, backs = (keyed(t, n, F.col("gram"), "p") for n, t in every), (keyed(t.select("lang", F.shiftright("gram", 6).alias("ctx"), "gamma").groupBy("lang", "ctx").agg(F.first("gamma").alias("gamma")), n, F.col("ctx"), "gamma") for n, t in every)
    return Model(langs, *(write_sorted(reduce(DataFrame.union, x)) for x in (probs, backs)))


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return np.diff(total[np.append(0, ends)])


_COUNTED, _SYMBOL = np.zeros(256, np.int64), np.zeros(256, np.int64)
_COUNTED[[b for b in range(256) if b & 0xC0 != 0x80 and b not in (32, *range(9, 14))]] = 1
_SYMBOL[list(SYMBOLS)] = 1


def measure(texts: list[bytes], langs: np.ndarray, model: Model) -> dict:
    lists = [x.split() for x in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    ends = np.cumsum(n)
    doc = np.repeat(np.arange(len(texts)), n)
    data = np.frombuffer(b"".join(texts), np.uint8)
    upto = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for words in lists for w in words), np.int64, len(doc))
    dups = []
    for text in texts:
        seen, k = set(), 0
        for line in text.split(b"\n"):
            if line not in seen:
                seen.add(line)
            elif line.split():
                k += 1
        dups.append(k)
    covered = np.zeros(len(doc) + 1, np.int64)
    if len(doc) >= WINDOW:
        mixed, key = splitmix(flat), splitmix(doc[: len(doc) - WINDOW + 1] + 1)
        for k in range(WINDOW):
            key = splitmix(key ^ mixed[k : len(doc) - WINDOW + 1 + k])
        key, at = key[whole := doc[WINDOW - 1 :] == doc[: len(doc) - WINDOW + 1]], np.flatnonzero(whole)
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        at = at[count[inverse] > 1]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + WINDOW, -1)
    repeated = (np.cumsum(covered[:-1]) > 0).astype(np.int64)
    words = list(ids)
    kinds, lang = np.unique(langs, return_inverse=True)
    pair, back = np.unique(flat * len(kinds) + lang[doc], return_inverse=True)
    gram, word, starts = grams_of([words[i] for i in pair // max(1, len(kinds))])
    if model.order and len(gram):
        log = np.bincount(word, weights=model.logs(kinds[pair % len(kinds)][word], gram), minlength=len(pair))
        length = np.bincount(word[starts], minlength=len(pair))
        log, length = _sums(log[back], ends), _sums(length[back], ends)
        ppl = np.where(length > 0, np.round(-log / np.maximum(length, 1), 9), np.nan)  # sums depend on what stands before in the run
    else:
        ppl = np.full(len(texts), np.nan)
    return {"n_words": n, "word_chars": _sums(_COUNTED[data], upto), "n_symbols": _sums(_SYMBOL[data], upto), "n_dup_lines": np.array(dups, np.int64), "n_repeat_words": _sums(repeated, ends), "log_ppl": ppl}


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with the counts of the base rules, log_ppl, lang_no and base_failed."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # names of files
    fields = ", ".join(f"{c} long" for c in STATS) + ", log_ppl double, lang_no long"
    numbered = with_number(docs, model.langs)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != "base_failed"]
    out = map_chunks(numbered, ["text", "__ld_lang"], lambda texts, langs: measure(texts, langs.to_numpy(zero_copy_only=False), shared.value) | {"lang_no": langs}, fields, keep)
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def judge(scored: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """scored with ppl_low, ppl_high (of the logarithm) and kept. Bands: one row a language."""
    q = F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10_000)
    bands = scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull()).groupBy("lang_no").agg(q.alias("q"))
    at = F.col("q")
    bands = bands.select("lang_no", at[1].alias("__ld_mid"), (low * (at[1] - at[0])).alias("__ld_low"), (high * (at[2] - at[1])).alias("__ld_high"))
    wide = F.greatest(F.lit(1.0), F.sqrt(F.lit(STEADY) / F.greatest("n_words", F.lit(1))))
    out = scored.join(F.broadcast(bands), "lang_no", "left")
    out = out.withColumn("ppl_low", F.col("__ld_mid") - wide * F.col("__ld_low")).withColumn("ppl_high", F.col("__ld_mid") + wide * F.col("__ld_high"))
    return out.drop("__ld_mid", "__ld_low", "__ld_high").withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("ppl_low"), F.col("ppl_high")), F.lit(True)))


def digest(docs: DataFrame) -> DataFrame:
    scored = cut(score(docs, fit(docs), ["doc_id"]))
    return judge(scored).select("doc_id", *STATS, "base_failed", "kept", "log_ppl", "ppl_low", "ppl_high")
