"""Suffix-array dedup: every byte that a 100-byte string covers which also starts earlier is removed.

Earlier is a smaller doc_id, or an earlier start in the same document; strings never cross documents and are judged on
the input. Anchors bring stretches of documents together that may share a window of 100 bytes; a Burrows-Wheeler transform
of these stretches says which windows do, and its intervals name what goes:

1. In a window, the anchor is the 36-byte gram of least hash (the leftmost); runs of windows with one anchor form a
   region. Equal windows have equal anchors, so only regions of anchors that occur twice matter.
2. Regions are pre-aggregated to classes of equal bytes (two 64-bit hashes): the first and the last occurrence and a count.
   Of each class both go on, as what they are in their documents: neighbouring regions of one pair of documents are one
   stretch on each side, cut at ``PIECE`` windows. Besides, the first occurrences of all classes of an anchor meet each
   other. An anchor of more than ``HOT`` classes is split by longer grams of 68 and then 84 bytes (extended to the left for
   windows that reach so far, else to the right), and what is still too much by whole windows.
3. Some hundred kilobytes of whole groups of stretches are one text, parts separated. Intervals of its suffix array are
   extended backward breadth first (Beller et al. 2013): common prefixes come out by increasing value, and the extension
   stops at 100. Suffixes whose common prefix was not derived share 100 bytes; of each such class of suffixes all but the
   earliest occurrence are marked. A third and further copy of a region takes over what was found of the last one.
4. Marked spans are merged in each document.

Edge cases: null is the empty text; texts under 100 bytes lose nothing; a null doc_id sorts first. Rows of one doc_id
are taken for one document: equal rows get equal answers, and if their texts differ, a span found in one is removed at
the same place in all. Other columns pass through, clashing ones are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, drop, map_chunks, slices, splitmix, spread
from lodestone.llm.sentencepiece_codec import BASE, INVERSE, powers

LEAST, GRAM, HOT, CHUNK, PIECE, LONG = 100, 36, 256, 1 << 17, 1 << 13, 1 << 20
#: From one length of gram to the next; a step is at most half of what is left, or all of it.
LENGTHS = {36: 68, 68: 84, 84: 100}
_PLACE = np.uint64((1 << 24) - 1)


#: Every 100-byte string in hexadecimal: for small tables.
ORACLE = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, len(h) // 2 AS n FROM t),
w AS (SELECT doc_id, p, substring(h, 2 * p + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS p FROM t WHERE len(h) >= 200)),
d AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
s AS (SELECT *, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS fresh FROM d),
g AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s),
m AS (SELECT doc_id, run, min(p) AS lo, max(p) + 100 AS hi FROM g GROUP BY 1, 2),
c AS (SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS prior FROM m),
k AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, max(hi) AS upto,
      string_agg(substring(h, 2 * prior + 1, 2 * (lo - prior)), '' ORDER BY lo) AS kept FROM c JOIN t USING (doc_id) GROUP BY 1)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(upto, 0) + 1))) AS kept_sha256
FROM t JOIN b ON b.doc_id = t.doc_id LEFT JOIN k ON k.doc_id = t.doc_id
"""


def anchors(texts: list[bytes]) -> dict:
    """Of each text its regions: first window, number of windows, the anchor's hash and place, the hash of the bytes."""
    if sum(map(len, texts)) <= 2 * LONG:
        return {"regions": _anchors(texts)}
    pieces = [(i, k, x[k : k + LONG + LEAST - 1]) for i, x in enumerate(texts) for k in range(0, max(1, len(x) - LEAST + 1), LONG)]
    values, counts = [], np.zeros(len(texts), np.int64)
    for s in slices(np.array([len(b) for _, _, b in pieces]), LONG):
        got = _anchors([b for _, _, b in pieces[s]])
        n = np.diff(got.offsets.to_numpy())
        np.add.at(counts, [i for i, _, _ in pieces[s]], n)
        columns = got.values.flatten()
        shifted = pa.array(columns[0].to_numpy() + np.repeat([k for _, k, _ in pieces[s]], n), pa.int32())
        values.append(pa.StructArray.from_arrays([shifted, *columns[1:]], REGION))
    return {"regions": pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.concat_arrays(values))}


REGION = ["s", "n", "h", "g", "r"]


def _anchors(texts: list[bytes]) -> pa.ListArray:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum(size)
    reach = LEAST - GRAM + 1
    n = len(data) - LEAST + 1
    if n <= 0:
        return pa.array([[] for _ in texts], pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("g", pa.int32()), ("r", pa.int64())])))
    inverse, sums = powers(INVERSE, len(data) + 1), np.zeros(len(data) + 1, np.uint64)
    np.cumsum(splitmix(np.arange(256))[data] * powers(BASE, len(data)), out=sums[1:])
    grams = splitmix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(data) - GRAM + 1])
    least = (grams & ~_PLACE) | (np.arange(len(grams), dtype=np.uint64) & _PLACE)
    width = 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: -(reach - width)], least[reach - width :])
    doc = np.repeat(np.arange(len(texts)), size)[:n]
    whole = np.arange(n) + LEAST <= end[doc]
    new = whole.copy()
    new[1:] &= (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    ends = np.searchsorted(first, np.append(0, end))
    last = np.append(first[1:], n)
    stop = np.minimum(last, end[doc[first]] - LEAST + 1)
    place = (least[first] - first.astype(np.uint64) & _PLACE).astype(np.int64)
    begin, upto = (end - size)[doc[first]], stop + LEAST - 1
    whole_hash = splitmix((sums[upto] - sums[first]) * inverse[first] ^ splitmix(upto - first)).view(np.int64)
    rows = pa.StructArray.from_arrays(
        [pa.array(first - begin, pa.int32()), pa.array(stop - first, pa.int32()), pa.array(grams[first + place].view(np.int64)), pa.array(place, pa.int32()), pa.array(whole_hash)], REGION
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


REGIONS = "regions array<struct<s:int,n:int,h:long,g:int,r:long,b:binary>>"


def extend(rows: list[bytes], s: pa.Array, n: pa.Array, g: pa.Array, length: int) -> dict:
    """The regions under longer grams: of LENGTHS[length] bytes; at LEAST each window goes alone."""
    more, out = LENGTHS[length] - length, []
    for b, s0, n0, g0 in zip(rows, s.to_pylist(), n.to_pylist(), g.to_pylist(), strict=True):
        left = max(0, min(n0, g0 - more + 1))
        pieces = [(0, left, g0 - more), (left, n0 - left, g0 - left)] if length + more < LEAST else [(i, 1, 0) for i in range(n0)]
        got = []
        for at, count, place in pieces:
            if count:
                part = b[at : at + count + LEAST - 1]
                key = xxhash.xxh64_intdigest(part[place : place + length + more], 2) - (1 << 63)
                got.append({"s": s0 + at, "n": count, "h": key, "g": place, "r": xxhash.xxh64_intdigest(part, 1) - (1 << 63), "b": part})
        out.append(got)
    return {"regions": out}


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first ``depth`` symbols at least (ties in any order), and the place of each; by prefix doubling.

    text: bytes plus one, 0 a separator. All separators are alike here, as no common prefix reaches over one. Keys begin
    with seven symbols of nine bits.
    """
    n = len(text)
    pad = np.append(text.astype(np.int64) + 1, np.zeros(6, np.int64))
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key << 9 | pad[k : n + k]
    step = 7
    while True:
        order = np.argsort(key)
        if step >= depth:
            break
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(1, ranked[1:] != ranked[:-1]))
        if rank[order[-1]] == n:
            break
        key = rank << 32
        key[: n - step] |= rank[step:]
        step *= 2
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order.astype(np.int32), place


def repeated(parts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Places in the parts (each followed by one separator) whose ``least`` bytes occur elsewhere, and their classes."""
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.int16) + 1
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    text[ends] = 0
    order, rank = suffix_order(text, least)
    n = len(text)
    back = rank[order - 1]  # where the suffix one symbol longer stands; order 0 wraps to a separator, which never extends
    symbol, start = text[order - 1], text[order]
    common = np.full(n + 1, -1, np.int32)
    common[0] = common[n] = 0
    lo, hi, tag, flag = np.zeros(1, np.int64), np.full(1, n - 1), np.empty(n, np.int32), np.zeros(n, bool)
    for value in range(least):
        size = hi - lo + 1
        at, of = spread(lo, size), np.repeat(np.arange(len(lo), dtype=np.int32), size)
        real = symbol[at] > 0
        to = back[at[real]]
        if not len(to):
            break
        tag[to] = of[real]
        if len(to) > n >> 5:  # in order: by marks where they are many, else by sorting
            flag[to] = True
            to = np.flatnonzero(flag)
            flag[to] = False
        else:
            to = np.sort(to).astype(np.int64)
        group, first = tag[to], start[to]
        cutoff = np.flatnonzero((to[1:] - to[:-1] != 1) | (group[1:] != group[:-1]) | (first[1:] != first[:-1]))
        lo, hi = to[np.append(0, cutoff + 1)], to[np.append(cutoff, len(to) - 1)]
        new = common[hi + 1] < 0
        common[hi[new] + 1] = value
        lo, hi = lo[new], hi[new]
    # too near a separator to have a window: such a suffix is in no class, and cuts off its neighbours
    short = (np.repeat(ends, np.diff(np.append(-1, ends))) - np.arange(n) < least)[order]
    common[:n][short] = 0
    common[1:][short] = 0
    same = np.flatnonzero(common[:n] < 0)
    if not len(same):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    flag[same] = flag[same - 1] = True
    inside = np.flatnonzero(flag)
    return order[inside].astype(np.int64), np.cumsum(common[inside] >= 0)


def hashes(texts: list[bytes]) -> pa.Array:
    """The anchors' hashes alone."""
    got = anchors(texts)["regions"]
    return pa.ListArray.from_arrays(got.offsets, got.values.field(2))


PARTS = "parts array<struct<p:long,s:int,b:binary,hot:boolean,n:int,g:int,regs:array<struct<f:int,n:int,h:long,r:long>>>>"


def gather(texts: list[bytes], lists: pa.Array, ids: pa.Array, hot: int) -> dict:
    """Of each document the stretches to transform, with their bytes, and the groups (p) in which they meet others.

    lists: regions that are the first (role 0) or last (1) occurrence of their class, with the other one (doc o, at t), or
    the first one of several classes of an anchor (2: in the group of the anchor h; set aside if it has over ``hot``). Both sides of a pair of documents find
    the same stretches, as they depend only on the regions' places in both.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    doc = np.repeat(np.arange(len(texts)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    col = {f.name: flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, f in enumerate(flat.type)}
    fits = col["s"] + col["n"] + LEAST - 1 <= size[doc]
    doc, col = doc[fits], {k: v[fits] for k, v in col.items()}
    one = np.flatnonzero(col["role"] == 2)
    two = np.flatnonzero(col["role"] < 2)
    early = np.where(col["role"] == 0, col["s"], col["t"])
    two = two[np.lexsort((early[two], col["o"][two], col["role"][two], doc[two]))]
    d, a, k = doc[two], early[two], {x: v[two] for x, v in col.items()}
    follows = (np.diff(d) == 0) & (np.diff(k["role"]) == 0) & (k["o"][1:] == k["o"][:-1])
    follows &= (k["s"][1:] == (k["s"] + k["n"])[:-1]) & (k["t"][1:] == (k["t"] + k["n"])[:-1])
    run = np.append(True, ~follows)[: len(two)]
    piece = (a - a[run][np.cumsum(run) - 1]) // PIECE
    first = np.flatnonzero(run | np.append(True, np.diff(piece) != 0)[: len(two)])
    last = np.append(first[1:], len(two)) - 1 if len(first) else first
    own = ids.to_numpy(zero_copy_only=False).view(np.int64)[d[first]]
    e, z = np.where(k["role"][first] == 0, own, k["o"][first]), np.where(k["role"][first] == 0, k["o"][first], own)
    pair = splitmix(splitmix(splitmix(e.view(np.uint64)) ^ z.view(np.uint64)) ^ a[first].view(np.uint64)).view(np.int64)
    many = (k["role"] == 1) & (k["c"] > 2)
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(two))))
    # the parts: stretches of pairs, then single regions; dealt to their documents
    which = np.concatenate([d[first], doc[one]])
    at = np.concatenate([k["s"][first], col["s"][one]])
    upto = np.concatenate([(k["s"] + k["n"])[last], (col["s"] + col["n"])[one]]) + LEAST - 1
    order = np.argsort(which, kind="stable")
    which, at, upto = which[order], at[order], upto[order]
    size_of = upto - at
    body = data[spread((np.cumsum(size) - size)[which] + at, size_of)]
    counts = np.concatenate([np.bincount(of[many], minlength=len(first)), np.zeros(len(one), np.int64)])[order]
    begins = np.append(0, np.cumsum(np.bincount(of[many], minlength=len(first))))
    inside = np.flatnonzero(many)[spread(np.append(begins[:-1], np.zeros(len(one), np.int64)).astype(np.int64)[order], counts)]
    regs = pa.StructArray.from_arrays([pa.array(k["s"][inside] - k["s"][first][of[inside]], pa.int32()), pa.array(k["n"][inside], pa.int32()), pa.array(k["h"][inside]), pa.array(k["r"][inside])], ["f", "n", "h", "r"])
    single = lambda v, none: pa.array(np.concatenate([np.full(len(first), none), v[one]])[order])
    made = [
        pa.array(np.concatenate([pair, col["h"][one]])[order]), pa.array(at, pa.int32()),
        pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(0, np.cumsum(size_of)).astype(np.int32)), pa.py_buffer(body)]),
        pa.array(np.concatenate([np.zeros(len(first), bool), col["k"][one] > hot])[order]), single(col["n"], 0).cast(pa.int32()), single(col["g"], 0).cast(pa.int32()),
        pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), regs),
    ]
    ends = np.searchsorted(which, np.arange(len(texts) + 1))
    return {"parts": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(made, ["p", "s", "b", "hot", "n", "g", "regs"]))}


MARKS = pa.schema([("doc", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("h", pa.int64()), ("r", pa.int64())])


def mark(doc: np.ndarray, at: np.ndarray, parts: list[bytes], regs: pa.Array) -> pa.RecordBatch:
    """Of whole groups of stretches (a document's bytes from a place on): spans to remove, a row (doc, lo, hi) each, and
    (h, r) of the given regions all of whose windows go."""
    place, group = repeated(parts)
    begins = np.cumsum([0] + [len(p) + 1 for p in parts])
    part = np.searchsorted(begins, place, "right") - 1
    key = np.unique(doc, return_inverse=True)[1][part] << 33 | place - begins[part] + at[part]
    new = np.append(True, np.diff(group) != 0)[: len(group)]
    late = key != np.minimum.reduceat(key, np.flatnonzero(new))[np.cumsum(new) - 1] if len(key) else np.empty(0, bool)
    place = np.sort(place[late])
    new = np.append(True, np.diff(place) != 1)[: len(place)]
    lo, hi = place[new], place[np.append(new[1:], True)[: len(place)]]
    part = np.searchsorted(begins, lo, "right") - 1
    shift = at[part] - begins[part]
    upto = np.zeros(begins[-1] + 2, np.int64)
    upto[place + 1] = 1
    upto = np.cumsum(upto)
    flat = regs.flatten()
    f, n, h, r = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
    start = begins[np.repeat(np.arange(len(parts)), pa.compute.list_value_length(regs).to_numpy(zero_copy_only=False))] + f
    whole = upto[start + n] - upto[start] == n
    nulls = lambda m, t: pa.nulls(int(m), t)
    m = int(whole.sum())
    made = [(pa.array(doc[part]), nulls(m, pa.int64())), (pa.array(lo + shift, pa.int32()), nulls(m, pa.int32())), (pa.array(hi + shift + LEAST, pa.int32()), nulls(m, pa.int32())), (nulls(len(lo), pa.int64()), pa.array(h[whole])), (nulls(len(lo), pa.int64()), pa.array(r[whole]))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in made], schema=MARKS)


def transform(parts: DataFrame) -> DataFrame:
    """Marks of all groups of stretches (columns p, doc, s, b, regs): one of (doc, lo, hi) or (h, r) a row."""

    def run(it):
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            doc, at, b, regs = (t.column(c).chunk(0) for c in ("doc", "s", "b", "regs"))
            return mark(doc.to_numpy(), at.to_numpy().astype(np.int64), b.to_pylist(), regs)

        size, before = 0, None
        for batch in it:
            groups, lengths, start = batch.column(0).to_numpy(), pa.compute.binary_length(batch.column(3)).to_numpy(), 0
            for i, (p, n) in enumerate(zip(groups.tolist(), lengths.tolist(), strict=True)):
                if size > CHUNK and p != before:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield out()
                    held, size, start = [], 0, i
                size, before = size + n, p
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield out()

    placed = parts.select("p", "doc", "s", "b", "regs").repartition("p").sortWithinPartitions("p")
    return placed.mapInArrow(run, "doc long, lo int, hi int, h long, r long")


def spans(docs: DataFrame) -> DataFrame:
    """(doc, lo, hi): byte spans to remove, not merged. docs: doc_id, text."""
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), "text")
    found = map_chunks(keyed, ["text"], anchors, "regions array<struct<s:int,n:int,h:long,g:int,r:long>>", ["doc"], 1 << 19).selectExpr("doc", "inline(regions)")
    only = map_chunks(keyed, ["text"], lambda texts: {"hs": hashes(texts)}, "hs array<long>", [], 1 << 19).select(F.explode("hs").alias("h"))
    twice = cut(only.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"))
    rows = cut(found.join(twice.hint("merge"), "h"))
    drop(twice)
    ends = (F.min(F.struct("doc", "s", "n", "g")).alias("f"), F.max(F.struct(F.col("doc").alias("o"), F.col("s").alias("t"))).alias("l"), F.count(F.lit(1)).alias("c"))
    least = cut(rows.groupBy("h", "r").agg(*ends).select("h", "r", "f.*", "l.*", "c"))
    kinds = least.groupBy("h").agg(F.count(F.lit(1)).alias("k"))
    first = "named_struct('doc', doc, 'role', 0, 's', s, 'n', n, 'o', o, 't', t, 'h', h, 'g', g, 'r', r, 'c', c, 'k', k)"
    last = "named_struct('doc', o, 'role', 1, 's', t, 'n', n, 'o', doc, 't', s, 'h', h, 'g', g, 'r', r, 'c', c, 'k', k)"
    among = first.replace("'role', 0", "'role', 2")
    twofold = "(doc <> o OR s <> t)"
    roles = least.join(kinds, "h").where(f"k > 1 OR {twofold}").selectExpr(f"inline(concat(if({twofold}, array({first}, {last}), array()), if(k > 1, array({among}), array())))")
    wanted = roles.groupBy("doc").agg(F.collect_list(F.struct("role", "s", "n", "o", "t", "h", "g", "r", "c", "k")).alias("rows"))  # a document's own regions
    got = cut(map_chunks(keyed.join(wanted.hint("merge"), "doc"), ["text", "rows", "doc"], lambda texts, lists, ids, hot=HOT: gather(texts, lists, ids, hot), PARTS, ["doc"], 1 << 18).selectExpr("doc", "inline(parts)"))
    marks = cut(transform(got.where("NOT hot")))
    out = [marks.where("doc IS NOT NULL").select("doc", "lo", "hi"), _others(rows, marks, least)]
    drop(rows, least)
    hot, length = cut(got.where("hot").select("doc", "s", "n", "g", "b")), GRAM
    drop(got)
    while not hot.isEmpty():
        longer = map_chunks(hot, ["b", "s", "n", "g"], lambda b, s, n, g, length=length: extend(b, s, n, g, length), REGIONS, ["doc"], 1 << 16)
        length = LENGTHS[length]
        longer = cut(longer.selectExpr("doc", "inline(regions)"))
        again = cut(longer.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h"))
        rows = cut(longer.join(again.hint("merge"), "h"))
        drop(longer, again, hot)
        ends = (F.min(F.struct("doc", "s", "n", "g", "b")).alias("f"), F.max(F.struct(F.col("doc").alias("o"), F.col("s").alias("t"), F.col("b").alias("z"))).alias("l"), F.count(F.lit(1)).alias("c"))
        least = cut(rows.groupBy("h", "r").agg(*ends).select("h", "r", "f.*", "l.*", "c"))
        kinds = least.groupBy("h").agg(F.count(F.lit(1)).alias("k"))
        least_k = least.join(kinds, "h")
        none = "cast(array() as array<struct<f:int,n:int,h:long,r:long>>)"
        part = "named_struct('p', {p}, 'doc', {doc}, 's', {s}, 'b', {b}, 'regs', {regs})".format
        early, late = part(p="xxhash64(h, r)", doc="doc", s="s", b="b", regs=none), part(p="xxhash64(h, r)", doc="o", s="t", b="z", regs=f"if(c > 2, array(named_struct('f', 0, 'n', n, 'h', h, 'r', r)), {none})")
        few = f"k > 1 AND k <= {HOT}" if length < LEAST else "k > 1"
        parts = least_k.selectExpr(f"inline(concat(if({twofold}, array({early}, {late}), array()), if({few}, array({part(p='h', doc='doc', s='s', b='b', regs=none)}), array())))")
        marks = cut(transform(parts))
        out += [marks.where("doc IS NOT NULL").select("doc", "lo", "hi"), _others(rows, marks, least)]
        hot = cut(least_k.where((F.col("k") > HOT) & F.lit(length < LEAST)).select("doc", "s", "n", "g", "b"))
        drop(rows, least)
    result = out[0]
    for x in out[1:]:
        result = result.union(x)
    return result


def _others(rows: DataFrame, marks: DataFrame, least: DataFrame) -> DataFrame:
    """Spans of the copies of regions between the first and the last, where the last one's windows all go."""
    done = cut(marks.where("h IS NOT NULL").select("h", "r").join(least.select("h", "r", F.col("doc").alias("d1"), F.col("s").alias("s1")).hint("merge"), ["h", "r"]))
    rest = rows.select("h", "r", "doc", "s", "n").join(done.hint("merge"), ["h", "r"]).where("doc <> d1 OR s <> s1")
    return cut(rest.select("doc", F.col("s").alias("lo"), (F.col("s") + F.col("n") + (LEAST - 1)).alias("hi")))


def strip(texts: list[bytes], lists: pa.Array, whole: bool) -> dict:
    out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []} | ({"text": []} if whole else {})
    for text, got in zip(texts, lists.to_pylist(), strict=True):
        merged: list[list[int]] = []
        for r in sorted((r["lo"], min(r["hi"], len(text))) for r in got or () if r["lo"] < len(text)):
            if merged and r[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], r[1])
            else:
                merged.append([*r])
        edges = [0, *[x for r in merged for x in r], len(text)]
        kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if merged else text
        out["n_bytes"].append(len(text))
        out["n_removed"].append(len(text) - len(kept))
        out["n_spans"].append(len(merged))
        out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        if whole:
            out["text"].append(kept.decode("utf-8", "replace"))
    return out


def dedup(docs: DataFrame, whole: bool = True, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with n_bytes, n_removed, n_spans, kept_sha256 and, if whole, the text that is left
    (bytes that no longer form a character become U+FFFD there; the digest is of the bytes)."""
    marked = spans(docs).groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("__ld_spans")).withColumnRenamed("doc", "__ld_key")
    keyed = docs.withColumn("__ld_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    joined = keyed.join(marked.hint("merge"), F.col("__ld_doc") == F.col("__ld_key"), "left")
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if whole else "")
    return map_chunks(joined, ["text", "__ld_spans"], lambda texts, lists: strip(texts, lists, whole), fields, docs.columns if keep is None else keep)


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text"), False, ["doc_id"])
