"""MinHash near-dedup by HyperMinHash: compressed registers, banding, corrected estimates, exact verification.

A document is the set of its distinct shingles of five words (A-Z lower-cased), as 64-bit hashes. The first byte of a
hash names one of 256 buckets; of a bucket's least hash the register keeps the number of leading zeros and the next ten
bits (Yu and Weber 2017). Documents of equal sets are one class from the start. Bands of registers propose groups;
for this alone an empty register borrows from another one by a fixed probe sequence (Shrivastava 2017), so that small
sets do not meet on a single common shingle. Groups of the same members count once.

0. A group of over ``BLOCK`` members is first linked to its least member: registers estimate, full sets confirm. If that
   connects all of it, it is done. Else it is dealt to blocks of at most ``BLOCK`` members each way; but where that makes more
   rows (for m members m / BLOCK rows each) than banding its members anew, by ``layout``'s double length and as many bands as its
   miss probability asks for, each of registers chosen by a fixed draw, these longer bands take the group's place.
1. In each block pair, registers cut to eight bits give the Jaccard estimates, less the expected chance collisions. A
   member without any partner within five standard errors of the threshold leaves the block; most leave here.
2. The others are compared with the least member of their block on the full sets; components of these links follow.
3. Blocks that still hold several components are compared within, only across components, estimate first (full
   registers) and full sets after; a block hands back at most a spanning forest, never its pairs.

So every pair that shares a band of a smaller group, or one of the longer bands, is compared or already connected; the latter
miss a pair at the threshold with a probability of ``MISS`` too. ``layout`` takes the longest bands that a pair at the
threshold misses with a probability of ``MISS`` at most: at 0.85 32 bands of 8 registers, all missed with a probability of
(1 - 0.85^8)^32, about 4e-5 (at 0.9, 2e-8); at 0.8 36 bands of 7, 2e-4.

Edge cases: a document of fewer than five words is one shingle, its whole sequence; null, empty and wordless texts have
no shingle and are linked with nothing. Rows of one doc_id are one document; rows without doc_id are linked with nothing
and kept. Other columns pass through, clashing ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, lookup, map_chunks, splitmix, with_columns
from lodestone.llm.components import components

WIDTH, BUCKETS, MANTISSA = 5, 256, 10
PROBES, MISS = 64, 2.5e-4
PERCENT = 85
BLOCK = 512
#: Registers of different sets that agree by chance, in all: 0.17 * 2^(p - r + 1) for 2^p buckets and r mantissa bits.
COLLISIONS = 0.1699 * 2.0 ** (8 - MANTISSA + 1)
#: Buckets of the short registers (eight bits, 0 is empty); two different ones agree once in 255 times.
SHORT = 128


#: All pairs that share a shingle: for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.node WHERE r.label < e.y),
m AS (SELECT node, min(label) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM m LEFT JOIN n ON n.doc_id = m.node JOIN (SELECT doc_id FROM documents) d ON d.doc_id = m.node
"""


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, text after text, and the number in each."""
    lists = [x.lower().split() for x in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in lists for w in ws), np.int64, int(n.sum()))
    words = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), np.uint64, len(ids))[flat]
    m = max(0, len(words) - WIDTH + 1)
    h = np.full(m, WIDTH, np.uint64)
    for k in range(WIDTH):
        h = splitmix(h ^ words[k : k + m])
    out, begin = [], 0
    for size in n:
        if size >= WIDTH:
            out.append(np.unique(h[begin : begin + size - WIDTH + 1]))
        elif size:
            one = np.full(1, size, np.uint64)
            for w in words[begin : begin + size]:
                one = splitmix(one ^ w)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
        begin += size
    return np.concatenate([np.empty(0, np.uint64), *out]), np.fromiter(map(len, out), np.int64, len(out))


def registers(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(texts, 256) of 16 bits: leading zeros plus one, then the mantissa; 0 is empty."""
    out = np.zeros((len(n), BUCKETS), np.uint16)
    cell = np.repeat(np.arange(len(n)), n) * BUCKETS + (h >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    rest = (h[first] & np.uint64((1 << 56) - 1)) >> np.uint64(4)  # 52 bits, exact as a float
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    whole = (rest << (52 - bits).astype(np.uint64)) & np.uint64((1 << 51) - 1)  # without the leading one
    out.reshape(-1)[cell[first]] = ((53 - bits) << MANTISSA) | (whole >> np.uint64(51 - MANTISSA)).astype(np.int64)
    return out


def sketch(texts: list[bytes]) -> dict:
    h, n = shingle_sets(texts)
    regs = registers(h, n)
    upto = np.append(0, np.cumsum(n))
    total = lambda x: np.diff(np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64))[upto]).view(np.int64)
    return {"n_shingles": n, "k1": total(splitmix(h)), "k2": total(splitmix(h ^ np.uint64(0x5BD1E995CAFEF00D))), "regs": [r.tobytes() for r in regs]}


def dense(regs: np.ndarray) -> np.ndarray:
    """Empty registers filled from others: the first full one of PROBES hashed places, else the next full one."""
    out, home = regs.copy(), np.arange(BUCKETS, dtype=np.uint64)
    open_rows = np.flatnonzero((regs == 0).any(axis=1) & regs.any(axis=1))
    for a in range(1, PROBES + BUCKETS):
        if not len(open_rows):
            break
        place = (splitmix(home * np.uint64(1000) + np.uint64(a)) % np.uint64(BUCKETS)).astype(np.int64) if a <= PROBES else (np.arange(BUCKETS) + a - PROBES) % BUCKETS
        now = out[open_rows]
        out[open_rows] = now = np.where(now == 0, regs[open_rows][:, place], now)
        open_rows = open_rows[(now == 0).any(axis=1)]
    return out


def layout(percent: int) -> tuple[int, int]:
    """Registers a band and bands: the longest bands that a pair of that similarity all misses with a probability of MISS at most."""
    return next((r, BUCKETS // r) for r in range(BUCKETS, 0, -1) if r == 1 or (1 - (percent / 100) ** r) ** (BUCKETS // r) <= MISS)


def draws(percent: int) -> np.ndarray:
    """(bands, registers): of double the length, as many as leave a pair of that similarity a probability of MISS to share none."""
    long = min(BUCKETS, 2 * layout(percent)[0])
    bands = int(np.ceil(np.log(MISS) / np.log1p(-min((percent / 100) ** long, 1 - 1e-9))))
    rng = np.random.default_rng(percent)
    return np.stack([rng.choice(BUCKETS, long, replace=False) for _ in range(bands)])


def long_keys(regs: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(texts, bands) keys of the chosen registers."""
    full = dense(regs).astype(np.uint64) << np.uint64(8)
    key = np.broadcast_to(np.arange(len(chosen), dtype=np.uint64) + np.uint64(1 << 20), (len(regs), len(chosen)))
    for k in range(chosen.shape[1]):
        key = splitmix(key ^ full[:, chosen[:, k]])
    return key.view(np.int64)


def band_keys(regs: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """(texts, bands) keys."""
    part = dense(regs)[:, : rows * bands].reshape(len(regs), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), part.shape[:2])
    for k in range(rows):
        key = splitmix(key ^ (part[:, :, k].astype(np.uint64) << np.uint64(8)))
    return key.view(np.int64)


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether registers a and b and set sizes leave a similarity of percent possible, five standard errors allowed."""
    used = ((a | b) > 0).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    t = percent / 100
    estimate = (same - COLLISIONS * (same < used)) / np.maximum(used, 1)
    return (estimate >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(used, 1))) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))


def short(regs: np.ndarray) -> np.ndarray:
    part = regs[:, :SHORT].astype(np.uint32)
    return np.where(part > 0, 1 + (part * np.uint32(0x9E3779B1) >> np.uint32(16)) % 255, 0).astype(np.uint8)


def partnered(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The members of a block pair that may be linked to another one."""
    pdf = pdf.drop_duplicates("doc", ignore_index=True)
    r, n, side = np.frombuffer(b"".join(pdf["short"]), np.uint8).reshape(-1, SHORT), pdf["n"].to_numpy(), pdf["side"].to_numpy()
    t, found = percent / 100, np.zeros(len(pdf), bool)
    for i in range(len(pdf) - 1):
        rest = slice(i + 1, len(pdf))
        used = ((r[i] | r[rest]) > 0).sum(axis=1)
        same = ((r[i] == r[rest]) & (r[i] > 0)).sum(axis=1)
        estimate = (same - used / 255) / np.maximum(used, 1) / (254 / 255)
        ok = (estimate >= t - 5 * np.sqrt(t * (1 - t) / np.maximum(used, 1))) | (used == 0)
        ok &= (100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest])) & ((side[rest] != side[i]) | (side[i] == 2))
        found[rest] |= ok
        found[i] |= ok.any()
    return pdf.loc[found, ["gid", "doc", "side"]]


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = int((lookup(a, b) >= 0).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist() if isinstance(column, pa.Array) else column), np.uint16).reshape(-1, BUCKETS)


def forest(pdf: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links across components within a block pair, as a spanning forest."""
    pdf = pdf.sort_values("doc", ignore_index=True)
    regs, n, side = _regs(pdf["regs"]), pdf["n"].to_numpy(), pdf["side"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    _, root = np.unique(pdf["comp"].to_numpy(), return_inverse=True)
    doc, out = pdf["doc"].to_numpy(), []
    for i in range(len(pdf) - 1):
        rest = np.arange(i + 1, len(pdf))
        rest = rest[(root[rest] != root[i]) & ((side[rest] != side[i]) | (side[i] == 2))]
        for j in rest[plausible(regs[i], regs[rest], n[i], n[rest], percent)] if len(rest) else ():
            if root[i] != root[j] and linked(sets[i], sets[j], percent):
                root[root == root[j]] = root[i]
                out.append((doc[i], doc[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)


def _groups(members: DataFrame) -> DataFrame:
    """(key, m, lo) of members (key, doc): groups of two at least, one of those with the same members."""
    x = F.bit_xor(F.xxhash64("doc")).alias("x1"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("x2")
    found = members.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("m"), *x).where("lo < hi")
    return found.groupBy("m", "x1", "x2").agg(F.min(F.struct("key", "lo")).alias("k")).select("k.key", "m", "k.lo")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, shingles) of the wanted documents (doc)."""

    def full(texts: list[bytes]) -> dict:
        h, n = shingle_sets(texts)
        upto = np.append(0, np.cumsum(n))
        return {"shingles": [h[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)]}

    chosen = docs.where(F.col("doc_id").isNotNull()).join(wanted.hint("merge"), F.col("doc_id") == F.col("doc"), "left_semi")
    return cut(map_chunks(chosen, ["text"], full, "shingles binary", ["doc_id"]).withColumnRenamed("doc_id", "doc"))


CHECKED = 1 << 22


def _check(percent: int):
    def check(_: list[bytes], a: pa.Array, b: pa.Array) -> dict:
        return {"ok": [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]}

    return check


def _apart(docs: DataFrame, reps: DataFrame, members: DataFrame, percent: int, longer_from: int) -> tuple[DataFrame, DataFrame]:
    """Of large groups (members: key, doc, lo, m): links to their least members, and (key, doc) of what these leave apart: the groups
    themselves, or the longer bands of those of over longer_from members."""
    pairs = members.where("doc > lo").select("doc", F.col("lo").alias("centre")).distinct()
    mine = reps.select("doc", "n", "regs")
    other = reps.select(F.col("doc").alias("centre"), F.col("n").alias("n2"), F.col("regs").alias("regs2"))
    both = pairs.join(mine.hint("merge"), "doc").join(other, "centre")

    def near(_: list[bytes], a: pa.Array, b: pa.Array, n: pa.Array, n2: pa.Array) -> dict:
        return {"near": plausible(_regs(a), _regs(b), n.to_numpy(), n2.to_numpy(), percent)}

    likely = cut(map_chunks(both, ["regs", "regs", "regs2", "n", "n2"], near, "near boolean", ["doc", "centre"]).where("near").select("doc", "centre"))
    sets = _sets(docs, likely.select("doc").union(likely.select("centre")).distinct())
    met = likely.join(sets.withColumnRenamed("shingles", "x").hint("merge"), "doc").join(sets.select(F.col("doc").alias("centre"), F.col("shingles").alias("y")).hint("merge"), "centre")
    links = cut(map_chunks(met, ["x", "x", "y"], _check(percent), "ok boolean", ["doc", "centre"], CHECKED).where("ok").select(F.col("doc").alias("a"), F.col("centre").alias("b")))
    comp = components(links, "a", "b").withColumnRenamed("node", "doc")
    placed = cut(members.select("key", "doc", "m").join(comp, "doc", "left").select("key", "doc", "m", F.coalesce("component", "doc").alias("comp")))
    apart = placed.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("key")
    open_ = cut(placed.join(apart, "key", "left_semi"))
    whole, left = open_.where(F.col("m") <= longer_from).select("key", "doc"), open_.where(F.col("m") > longer_from).select("doc", "comp").distinct()
    if left.isEmpty():
        return links, whole
    chosen = draws(percent)
    keyed = map_chunks(left.join(mine.hint("merge"), "doc"), ["regs", "regs"], lambda _, regs: {"keys": list(long_keys(_regs(regs), chosen))}, "keys array<long>", ["doc", "comp"]).select("doc", "comp", F.explode("keys").alias("key"))
    mixed = cut(keyed.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("key"))
    return links, whole.union(cut(keyed.join(mixed.hint("merge"), "key").select("key", "doc")))


def group(docs: DataFrame, percent: int = PERCENT, longer_from: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs. longer_from: the size of a group from which longer bands make
    fewer rows than blocks."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = cut(map_chunks(docs, ["text"], sketch, "n_shingles long, k1 long, k2 long, regs binary", ["doc_id"]))
    real = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(real.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")))
    on = (F.col("doc_id") == F.col("rep")) & (F.col("s.k1") == F.col("c.k1")) & (F.col("s.k2") == F.col("c.k2"))
    reps = cut(real.alias("s").join(classes.alias("c"), on, "left_semi").dropDuplicates(["doc_id", "k1", "k2"]).select(F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"), "regs"))

    shape = layout(percent)

    def bands(_: list[bytes], regs: pa.Array) -> dict:
        return {"keys": list(band_keys(_regs(regs), *shape))}

    banded = map_chunks(reps, ["regs", "regs"], bands, "keys array<long>", ["doc"]).select("doc", F.explode("keys").alias("key"))
    shared = cut(banded.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key"))
    members = cut(banded.join(shared.hint("merge"), "key"))
    one_each = cut(_groups(members))
    hot = one_each.where(F.col("m") > BLOCK)
    before = None
    if not hot.isEmpty():
        most = BLOCK * len(draws(percent)) if longer_from is None else longer_from
        before, apart = _apart(docs, reps, cut(members.join(hot.select("key", "lo", "m"), "key")), percent, most)
        members = cut(members.join(one_each.where(F.col("m") <= BLOCK).select("key"), "key", "left_semi").union(apart))
        one_each = cut(_groups(members))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = members.join(one_each.select("key", "m"), "key").withColumn("bs", blocks).withColumn("b", F.pmod(F.xxhash64("doc", F.lit(2)), blocks).cast("int"))
    # a block meets each other block once, and itself (side 2: all pairs within count)
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("bs") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o")).alias("gid"), "doc", F.when(F.col("b") == F.col("o"), 2).when(F.col("b") < F.col("o"), 0).otherwise(1).alias("side"))
    brief = map_chunks(reps, ["regs", "regs"], lambda _, regs: {"short": [x.tobytes() for x in short(_regs(regs))]}, "short binary", ["doc", "n"])
    met = cut(dealt.join(brief.hint("merge"), "doc").groupBy("gid").applyInPandas(lambda pdf: partnered(pdf, percent), "gid long, doc long, side int"))
    centres = cut(met.groupBy("gid").agg(F.min("doc").alias("centre")))
    placed = cut(met.join(centres, "gid"))
    pairs = placed.where("doc > centre").select("doc", "centre").distinct()
    wanted = met.select("doc").distinct()

    sets = _sets(docs, wanted)

    checked = pairs.join(sets.withColumnRenamed("shingles", "x").hint("merge"), "doc").join(sets.select(F.col("doc").alias("centre"), F.col("shingles").alias("y")).hint("merge"), "centre")
    links = map_chunks(checked, ["x", "x", "y"], _check(percent), "ok boolean", ["doc", "centre"], CHECKED).where("ok").select(F.col("doc").alias("a"), F.col("centre").alias("b"))
    links = cut(links if before is None else links.union(before))
    first = components(links, "a", "b")
    own = F.coalesce("component", "doc").alias("comp")
    placed = cut(placed.join(first.withColumnRenamed("node", "doc"), "doc", "left").select("gid", "doc", "side", own))
    still = cut(placed.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("gid"))
    loaded = placed.join(still, "gid").join(sets.hint("merge"), "doc").join(reps.hint("merge"), "doc").dropDuplicates(["gid", "doc", "n"])
    more = cut(loaded.groupBy("gid").applyInPandas(lambda pdf: forest(pdf, percent), "a long, b long"))
    final = components(links.union(more), "a", "b")
    named = cut(classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id")))
    joined = real.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    alone = sketches.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pipeline's stage: of each group of near copies the document with the least doc_id stays."""
    gone = cut(group(docs, percent).where("NOT kept").select(F.col("doc_id").alias("__ld_gone")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["__ld_gone"], "left_anti")


def label(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs with n_shingles, component_id and kept."""
    found = group(docs, percent).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("__ld_id"), *[F.col(c).alias(f"__ld_{c}") for c in ("n_shingles", "component_id", "kept")])
    out = docs.join(found, docs["doc_id"].eqNullSafe(F.col("__ld_id")), "left")
    return with_columns(out, {c: F.col(f"__ld_{c}") for c in ("n_shingles", "component_id", "kept")}).drop("__ld_id", *[f"__ld_{c}" for c in ("n_shingles", "component_id", "kept")])
