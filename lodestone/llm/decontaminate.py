"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items and texts are compared with ASCII letters lower-cased and runs of white space made one space, as UTF-8
bytes. A long item counts as overlapping segments of ``SEGMENT`` bytes (each ``SEGMENT / 2`` after the one before, the
last at the end), a shorter one as itself. A document is contaminated if some part of it is within ``m // 10`` edits of a
segment of m bytes. The lemma: such a part shares at least m - q + 1 - q * edits of the segment's q-grams, and their
diagonals (place in the text less place in the segment) lie within that many of each other. So hits are counted in
diagonal bands of twice the budget that overlap by half; bands that meet the bound are retained and verified by an
alignment banded to the same diagonals.

The benchmark is read in blocks of at most ``BLOCK`` bytes, each an index that goes to every task; documents are never
joined with it. One block serves up to that size, further ones make further passes.

Short items would be told from chance too poorly with edits: one of under ``LEAST`` bytes has no budget, and its match must
begin and end where words do; one of under ``Q`` bytes matches only a text that consists of it.

Edge cases: null or empty texts match nothing; null and blank items are ignored; an empty benchmark keeps all, an empty
table stays empty. Hits are counted ``HITS`` at a time, so that runs of one byte in long texts and items need no more memory.
Repeated items count each under its item_id. Equal rows get equal answers; clashing columns are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import as_bytes, cut, lookup, map_chunks, slices, spread

Q, SEGMENT, LEAST, BLOCK, HITS, PASSES = 8, 100, 40, 2 << 20, 1 << 22, 8
FILTER = 22
ODD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: bytes) -> bytes:
    return b" ".join(text.lower().split())


def grams(data: bytes) -> np.ndarray:
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data, 0, (1,)) if len(data) >= Q else np.empty(0, np.uint64)


class Index:
    def __init__(self, ids: list[int], texts: list[bytes]):
        self.item, self.segments, self.tiny = [], [], {}
        for i, t in zip(ids, map(normal, texts), strict=True):
            if 0 < len(t) < Q:
                self.tiny.setdefault(t, []).append(i)
            elif t:
                step = SEGMENT // 2
                starts = [*range(0, len(t) - SEGMENT, step), len(t) - SEGMENT] if len(t) > SEGMENT + step else [0]
                for s in starts:
                    self.item.append(i)
                    self.segments.append(t[s : s + SEGMENT] if len(starts) > 1 else t)
        self.size = np.array([len(x) for x in self.segments], np.int64)
        self.budget = np.where(self.size < LEAST, 0, self.size // 10)
        self.least = np.maximum(1, self.size - Q + 1 - Q * self.budget)
        self.half = int(self.budget.max()) + 1 if len(self.size) else 1
        each = [grams(x) for x in self.segments]
        flat = np.concatenate([np.empty(0, np.uint64), *each])
        seg = np.repeat(np.arange(len(each), dtype=np.int32), [len(x) for x in each])
        off = np.concatenate([np.empty(0, np.int16), *[np.arange(len(x), dtype=np.int16) for x in each]])
        order = np.argsort(flat, kind="stable")
        self.keys, self.at, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.seg, self.off = seg[order], off[order]
        self.likely = np.zeros(1 << FILTER, bool)
        self.likely[(self.keys * ODD) >> np.uint64(64 - FILTER)] = True

    def candidates(self, data: bytes, rows: np.ndarray) -> np.ndarray:
        """(n, 3): row, segment and first diagonal of every band that meets the lemma's bound. rows: of each byte of data."""
        g = grams(data)
        at = np.flatnonzero(self.likely[(g * ODD) >> np.uint64(64 - FILTER)])
        found = lookup(self.keys, g[at])
        at, found = at[found >= 0], found[found >= 0]
        n = self.count[found]
        parts = [*slices(n, HITS)]
        width, many, counted = 2 * self.half, max(1, len(self.segments)), {0: [], self.half: []}
        for part in parts:
            place = spread(self.at[found[part]], n[part])
            pos = np.repeat(at[part], n[part])
            seg, diag = self.seg[place], pos - self.off[place] + SEGMENT * 2
            pair = rows[pos] * many + seg
            if len(parts) == 1:  # all hits are here: first by pairs alone
                _, back, total = np.unique(pair, return_inverse=True, return_counts=True)
                some = total[back] >= self.least[seg]
                pair, diag = pair[some], diag[some]
            for shift, held in counted.items():
                held.append(np.unique(pair << 26 | (diag + shift) // width, return_counts=True))  # texts are far under 2^26 bands
        out = [np.empty((0, 3), np.int64)]
        for shift, held in counted.items() if parts else ():
            key, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            total = np.bincount(back, weights=np.concatenate([c for _, c in held]), minlength=len(key))
            pairs = key >> 26
            good = total >= self.least[pairs % many]
            out.append(np.stack([pairs[good] // many, pairs[good] % many, (key[good] & (1 << 26) - 1) * width - shift - SEGMENT * 2], axis=1))
        return np.unique(np.concatenate(out), axis=0)

    def verify(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The least edits of each candidate within its band (budget + 1: more). begin, end: of its row in data."""
        best = np.empty(len(found), np.int64)
        for m in np.unique(self.size[found[:, 1]]) if len(found) else ():
            which = np.flatnonzero(self.size[found[:, 1]] == m)
            for part in np.array_split(which, max(1, len(which) * int(m) // 200_000)):
                pattern = np.stack([np.frombuffer(self.segments[s], np.uint8) for s in found[part, 1]])
                e = int(self.budget[found[part[0], 1]])  # as all of the size
                lanes = np.arange(2 * self.half + 2 * e + 1)
                first = found[part, 2] - e
                inside = lambda j: (j >= begin[part, None]) & (j < end[part, None])
                cost = np.where((first[:, None] + lanes >= begin[part, None]) & (first[:, None] + lanes <= end[part, None]), 0, e + 1).astype(np.int32)
                for i in range(int(m)):
                    j = first[:, None] + i + lanes
                    ok = inside(j)
                    same = ok & (data[np.where(ok, j, 0)] == pattern[:, i : i + 1])
                    new = cost + np.where(ok, ~same, e + 1)
                    new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a byte of the pattern is missing in the text
                    cost = np.minimum.accumulate(new - lanes, axis=1) + lanes  # the text has bytes more
                    j_end = j + 1
                    cost[(j_end < begin[part, None]) | (j_end > end[part, None])] = e + 1
                best[part] = np.minimum(cost.min(axis=1), e + 1)
        return best

    def match(self, texts: list[bytes]) -> dict:
        items: list[list[int]] = [[] for _ in texts]
        edits: list[int | None] = [None] * len(texts)
        clean = [normal(x) for x in texts]
        joined = b"\n".join([*clean, b""]) + b"\0" * Q  # white space is single spaces, so no q-gram crosses a text
        lens = np.fromiter(map(len, clean), np.int64, len(clean)) + 1
        end = np.cumsum(lens) - 1
        begin = end - lens + 1
        rows = np.repeat(np.arange(len(clean)), lens)
        if len(self.segments):
            found = self.candidates(joined, np.append(rows, np.full(Q, len(clean) - 1)))
            best = self.verify(np.frombuffer(joined, np.uint8), begin[found[:, 0]], end[found[:, 0]], found)
            for (row, seg, _), d in zip(found.tolist(), best.tolist(), strict=True):
                short = self.size[seg] < LEAST
                if d <= self.budget[seg] and (not short or b" " + self.segments[seg] + b" " in b" " + clean[row] + b" "):
                    if self.item[seg] not in items[row]:
                        items[row].append(self.item[seg])
                    edits[row] = d if edits[row] is None else min(edits[row], d)
        for row, text in enumerate(clean):
            if text in self.tiny:
                items[row] += [i for i in self.tiny[text] if i not in items[row]]
                edits[row] = 0
        return {"item_ids": [sorted(x) for x in items], "min_edits": edits}


def indexes(benchmark: DataFrame, block: int = BLOCK):
    """An index for each block of items; a block has about ``block`` bytes at most (or one item)."""
    rows = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 if total <= block else 2 * -(-total // block)
    for k in range(parts):
        got = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).toPandas()
        yield Index(got["item_id"].tolist(), as_bytes(got["text"]))


def screen(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """docs (or its columns ``keep``) with item_ids (matched items, ascending), min_edits (null: none) and kept."""
    out, names, text = docs, (docs.columns if keep is None else keep), "text"
    out = out.withColumn("__ld_text", F.col(text))
    fields = "item_ids array<long>, min_edits int"
    work = ["__ld_text", "__ld_items", "__ld_edits"]
    out = out.withColumns({"__ld_items": F.expr("cast(array() as array<bigint>)"), "__ld_edits": F.expr("cast(null as int)")})
    for number, index in enumerate(indexes(benchmark, block)):
        if number and number % PASSES == 0:
            out = cut(out)  # a plan holds so many passes at most
        shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the block
        got = map_chunks(out, ["__ld_text"], lambda texts, shared=shared: shared.value.match(texts), fields, [*(n for n in names if n not in work), *work])
        merged = {"__ld_items": F.sort_array(F.array_union("__ld_items", "item_ids")), "__ld_edits": F.least("__ld_edits", "min_edits")}
        out = got.withColumns(merged)
    plain = [n for n in names if n.lower() not in ("item_ids", "min_edits", "kept")]
    return out.select(*plain, F.col("__ld_items").alias("item_ids"), F.col("__ld_edits").alias("min_edits"), (F.size("__ld_items") == 0).alias("kept"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return screen(docs, benchmark, ["doc_id"]).select("doc_id", "kept", "item_ids", "min_edits")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's stage: contaminated documents go."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__ld_row")
    return screen(docs.select("text", row), benchmark, ["__ld_row"]).where("kept").select("__ld_row.*")
