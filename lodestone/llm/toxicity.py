"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs, in numpy.

A word's input is the vector of the word (words of at least ``MIN_DOCS`` documents of the training sample, else none)
beside the mean vectors of its character trigrams and of its beginnings of 3 to 8 bytes (compounds share them). Two gated recurrent layers read a window of ``SPAN`` words forward and
backward, attention pools their states, and a logistic unit scores the window. All windows of a text, each overlapping
half of the one before, are scored; a text's score is its highest window's, calibrated by a logistic curve.

Labels are of documents, not of windows, so each epoch learns a toxic document from its currently highest window and a
clean one from its highest and a random one. Training uses a bounded sample of rows (``PER_CLASS`` labelled documents a
class), and all windows of their whole texts; every whole text is scored.

Edge cases: null and empty texts, or texts without words, get the score of an empty window; without labelled rows of
both classes every score is the share of toxic labels (0 if there are none). Equal texts get equal scores. Labels for
unknown documents and null labels are ignored. Clashing columns are replaced.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import as_bytes, held_out, lookup, map_chunks

SPAN, STEP = 64, 32
DIM, HIDDEN, TRIGRAMS = 12, 12, 1 << 12
BEGINNINGS, BITS = range(3, 9), 15
PER_CLASS, MIN_DOCS = 1500, 6
EPOCHS, BATCH, RATE = 11, (32, 256), 0.01
MARKS = b".,!?;:\"'()*#$%&|<>"
THRESHOLD = 0.3


def split(text: bytes) -> list[bytes]:
    return [w.strip(MARKS) for w in text.lower().split()]


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash classes of the character (byte) trigrams of ``^word$``, word after word, and where each word's begin."""
    data = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint32)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = data[:-2] * np.uint32(0x01000193) ^ data[1:-1]
    code = (code * np.uint32(0x01000193) ^ data[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - 12)
    code = np.append(code, [0, 0]).astype(np.int64)
    ends = np.cumsum(n)
    inside = np.ones(len(code), bool)
    inside[ends - 1] = False
    inside[ends - 2] = n == 2  # an empty word keeps one
    count = np.maximum(n - 2, 1)
    return code[inside], np.cumsum(count) - count


def beginnings(words: list[bytes]) -> np.ndarray:
    """(words, 6): the hash class of each beginning that is shorter than its word, else 0."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words) + b"\0" * BEGINNINGS.stop, np.uint8).astype(np.uint32)
    at, code, out = np.cumsum(n) - n, np.zeros(len(words), np.uint32), []
    for k in range(1, BEGINNINGS.stop):
        code = code * np.uint32(0x01000193) ^ data[at + k - 1]
        if k in BEGINNINGS:
            out.append(np.where(n > k, (code * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)) + np.uint32(1), 0))
    return np.stack(out, axis=1).astype(np.int64)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words: each window's text, its first word and its number of words (an empty text has one)."""
    n = np.maximum(0, -(-(counts - SPAN) // STEP)) + 1
    text = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(counts) - counts)[text] + k * STEP
    return text, first, np.minimum(SPAN, counts[text] - k * STEP)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    def __init__(self, keys: np.ndarray, seed: int = 1):
        r, h, d = np.random.default_rng(seed), HIDDEN, 3 * DIM
        w = lambda *s, k=1.0: (r.standard_normal(s) * k).astype(np.float32)
        self.keys = keys  # sorted crc32 of the known words; vector 0 is for all others
        self.p = {"E": w(len(keys) + 1, DIM, k=0.1), "C": w(TRIGRAMS, DIM, k=0.1), "Q": w((1 << BITS) + 1, DIM, k=0.1), "A": w(2 * h, h, k=0.3), "a": w(h, k=0.3), "o": w(2 * h, k=0.3), "b": np.zeros(1, np.float32)}
        for s in "fb":
            self.p |= {f"W{s}": w(d, 3 * h, k=0.3), f"U{s}": w(h, 3 * h, k=0.3), f"c{s}": np.zeros(3 * h, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def word_rows(self, words: list[bytes]) -> np.ndarray:
        return lookup(self.keys, np.fromiter(map(crc32, words), np.int64, len(words))) + 1

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        rows, (tri, at) = self.word_rows(words), trigrams(words)
        n, pre = np.diff(np.append(at, len(tri))), beginnings(words)
        chars = np.add.reduceat(self.p["C"][tri], at, axis=0) / n[:, None] if len(words) else np.zeros((0, DIM))
        known = (pre > 0).astype(np.float32) / len(BEGINNINGS)
        start = sum(self.p["Q"][pre[:, k]] * known[:, k : k + 1] for k in range(len(BEGINNINGS)))
        return np.concatenate([self.p["E"][rows], chars, start], axis=1).astype(np.float32), (rows, tri, n, pre, known)

    def run(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows. ids: (SPAN, windows) of rows of x; mask: 1 where there is a word. keep: also what backward() needs."""
        p, h, (steps, m) = self.p, HIDDEN, ids.shape
        states, saved = np.zeros((steps, m, 2 * h), np.float32), {}
        for s, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            proj, u, half = x @ p[f"W{s}"] + p[f"c{s}"], p[f"U{s}"], slice(0, h) if s == "f" else slice(h, 2 * h)
            state, trail = np.zeros((m, h), np.float32), []
            for t in order:
                if not keep and not mask[t].any():
                    state = np.zeros((m, h), np.float32)
                    continue
                g, r = proj[ids[t]], state @ u
                zr = sigmoid(g[:, : 2 * h] + r[:, : 2 * h])
                z, q = zr[:, :h], zr[:, h:]
                n = np.tanh(g[:, 2 * h :] + q * r[:, 2 * h :])
                new = (n + z * (state - n)) * mask[t][:, None]
                if keep:
                    trail.append((t, state, z, q, n, r[:, 2 * h :]))
                state = new
                states[t, :, half] = state
            saved[s] = trail
        v = np.tanh(states @ p["A"])
        e = np.where(mask > 0, v @ p["a"], -1e9)
        e = np.exp(e - e.max(axis=0)) * mask
        w = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = (w[:, :, None] * states).sum(axis=0)
        logit = pooled @ p["o"] + p["b"][0]
        return (logit, (states, saved, v, w, pooled)) if keep else logit

    def backward(self, x, ids, mask, kept, d_logit) -> tuple[dict, np.ndarray]:
        p, h, (states, saved, v, w, pooled) = self.p, HIDDEN, kept
        g = {"o": pooled.T @ d_logit, "b": np.array([d_logit.sum()])}
        d_pool = d_logit[:, None] * p["o"]
        d_states = w[:, :, None] * d_pool
        d_w = (states * d_pool).sum(axis=2)
        d_e = w * (d_w - (w * d_w).sum(axis=0))
        g["a"] = np.einsum("tmh,tm->h", v, d_e)
        d_v = d_e[:, :, None] * p["a"] * (1 - v * v)
        g["A"] = np.einsum("tmi,tmh->ih", states, d_v)
        d_states = d_states + d_v @ p["A"].T
        d_x = np.zeros_like(x)
        for s in "fb":
            u, half = p[f"U{s}"], slice(0, h) if s == "f" else slice(h, 2 * h)
            carry, d_u, d_proj = 0, np.zeros_like(u), np.zeros((len(x), 3 * h), np.float32)
            for t, before, z, q, n, rn in reversed(saved[s]):
                d = (d_states[t, :, half] + carry) * mask[t][:, None]
                d_n = d * (1 - z) * (1 - n * n)
                d_z = d * (before - n) * z * (1 - z)
                d_q = d_n * rn * q * (1 - q)
                gate = np.concatenate([d_z, d_q, d_n * q], axis=1)
                d_u += before.T @ gate
                carry = d * z + gate @ u.T
                np.add.at(d_proj, ids[t], np.concatenate([d_z, d_q, d_n], axis=1))
            g |= {f"U{s}": d_u, f"W{s}": x.T @ d_proj, f"c{s}": d_proj.sum(axis=0)}
            d_x += d_proj @ p[f"W{s}"].T
        return g, d_x

    def logits(self, texts: list[bytes], group: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Each window's text and logit."""
        lists = [split(x) for x in texts]
        ids: dict[bytes, int] = {b"": 0}
        flat = np.fromiter((ids.setdefault(w, len(ids)) for ws in lists for w in ws), np.int64)
        x, _ = self.inputs(list(ids))
        text, first, size = windows(np.fromiter(map(len, lists), np.int64, len(lists)))
        out = np.empty(len(text), np.float32)
        flat = np.append(flat, 0)
        by_size = np.argsort(size, kind="stable")
        for i in range(0, len(text), group):
            part = by_size[i : i + group]
            step = np.arange(max(1, int(size[part].max())))[:, None]
            mask = step < size[part]
            out[part] = self.run(x, flat[np.where(mask, first[part] + step, len(flat) - 1)], mask.astype(np.float32))
        return text, out

    def answer(self, texts: list[bytes]) -> dict:
        if not texts:
            return {"score": np.empty(0)}
        text, z = self.logits(texts)
        best = np.maximum.reduceat(z, np.flatnonzero(np.append(True, np.diff(text) > 0)))
        return {"score": sigmoid(self.scale * best.astype(np.float64) + self.shift)}


class Constant:
    def __init__(self, share: float):
        self.share = share

    def answer(self, texts: list[bytes]) -> dict:
        return {"score": np.full(len(texts), self.share)}


def fit_texts(texts: list[bytes], labels: np.ndarray, share: float, seed: int = 1) -> Network | Constant:
    """share: of toxic ones among all labelled rows, for the calibration (the sample is balanced)."""
    if len(set(labels.tolist())) < 2:
        return Constant(share)
    rng = np.random.default_rng(seed)
    lists = [split(x) for x in texts]
    seen: dict[int, int] = {}
    for ws in lists:
        for k in {crc32(w) for w in ws}:
            seen[k] = seen.get(k, 0) + 1
    net = Network(np.array(sorted(k for k, n in seen.items() if n >= MIN_DOCS), np.int64), seed)
    ids: dict[bytes, int] = {b"": 0}
    flat = np.append(np.fromiter((ids.setdefault(w, len(ids)) for ws in lists for w in ws), np.int64), 0)
    words = list(ids)
    text, first, size = windows(np.fromiter(map(len, lists), np.int64, len(lists)))
    train = rng.random(len(texts)) < 0.8
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    tick = 0

    def gather(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        step = np.arange(max(1, int(size[part].max())))[:, None]
        mask = step < size[part]
        return flat[np.where(mask, first[part] + step, len(flat) - 1)], mask.astype(np.float32)

    def score_all() -> np.ndarray:
        x, _ = net.inputs(words)
        return np.concatenate([net.run(x, *gather(np.arange(i, min(i + 2048, len(text))))) for i in range(0, len(text), 2048)])

    starts = np.flatnonzero(np.append(True, np.diff(text) > 0))
    many = np.diff(np.append(starts, len(text)))
    size_of = int(np.clip(len(texts) // 6, *BATCH))
    for epoch in range(EPOCHS):
        z = rng.random(len(text)) if epoch == 0 else score_all()
        order = np.lexsort((-z, text))  # each text's windows, the highest first
        chosen = np.concatenate([order[starts], (starts + rng.integers(0, many))[labels == 0]])
        chosen = rng.permutation(chosen[train[text[chosen]]])
        for i in range(0, len(chosen), size_of):
            part = chosen[i : i + size_of]
            where, mask = gather(part)
            used, local = np.unique(where, return_inverse=True)
            x, (rows, tri, n, pre, known) = net.inputs([words[w] for w in used])
            drop = (rng.random(len(used)) < 0.1) & (used > 0)  # a word now and then unknown
            x[drop, :DIM], rows = net.p["E"][0], np.where(drop, 0, rows)
            local = local.reshape(where.shape)
            z, kept = net.run(x, local, mask, keep=True)
            d_logit = ((sigmoid(z) - labels[text[part]]) / len(part)).astype(np.float32)
            g, d_x = net.backward(x, local, mask, kept, d_logit)
            g |= {k: np.zeros_like(net.p[k]) for k in "ECQ"}
            np.add.at(g["E"], rows, d_x[:, :DIM])
            np.add.at(g["C"], tri, np.repeat(d_x[:, DIM : 2 * DIM] / n[:, None], n, axis=0))
            for k in range(len(BEGINNINGS)):
                np.add.at(g["Q"], pre[:, k], d_x[:, 2 * DIM :] * known[:, k : k + 1])
            tick += 1
            for k, v in net.p.items():
                m1, m2 = moment[k]
                gk = g[k] + (1e-4 * v if k in "ECQ" else 0)
                m1 += 0.1 * (gk - m1)
                m2 += 0.01 * (gk * gk - m2)
                v -= (RATE * (m1 / (1 - 0.9**tick)) / (np.sqrt(m2 / (1 - 0.99**tick)) + 1e-6)).astype(np.float32)
    best = np.maximum.reduceat(score_all(), starts).astype(np.float64)
    rest = ~train if len(set(labels[~train].tolist())) == 2 else np.ones(len(texts), bool)
    y, b = labels[rest], best[rest]
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    for _ in range(500):  # logistic regression of two numbers, lightly held near the identity
        d = weight * (sigmoid(net.scale * b + net.shift) - y)
        net.scale -= 0.2 * ((d * b).mean() / max(1.0, (b * b).mean()) + 1e-3 * (net.scale - 1))
        net.shift -= 0.5 * (d.mean() + 1e-3 * net.shift)
    net.scale = max(net.scale, 0.1)
    return net


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2) -> Network | Constant:
    """Learn from up to PER_CLASS rows of each label whose id is not held out: of each of so many hash classes the least hash."""
    rows = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), modulus, rest)).select("doc_id", "toxic")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id").where(F.col("doc_id").isNotNull()), "doc_id", "left_semi")
    keyed = rows.select("doc_id", "toxic", F.xxhash64("doc_id").alias("k"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PER_CLASS)).alias("part"))
    least = keyed.groupBy("toxic", "part").agg(F.min(F.struct("k", "doc_id")).alias("k"), F.count(F.lit(1)).alias("n"))
    chosen = least.select("toxic", F.col("k.doc_id").alias("doc_id"), "n").toPandas()  # 2 * PER_CLASS rows at most
    if chosen.empty:
        return Constant(0.0)
    share = float(chosen.loc[chosen["toxic"] == 1, "n"].sum() / chosen["n"].sum())
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen[["doc_id", "toxic"]]))
    got = docs.join(picked, "doc_id").select("doc_id", "toxic", "text").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    return fit_texts(as_bytes(got["text"]), got["toxic"].to_numpy(), share)


def score(docs: DataFrame, model: Network | Constant, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with score, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words
    return map_chunks(docs, ["text"], lambda texts: shared.value.answer(texts), "score double", keep)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels), ["doc_id"])
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id"), 4, 2), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
