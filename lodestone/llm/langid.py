"""Language ID by a string kernel: blended-spectrum n-gram presence, Nystroem landmarks, one-versus-rest kernel ridge.

A text is the set of its byte n-grams (ASCII letters lower-cased) of lengths 2 to 4, as hashes of ``BITS`` bits. The kernel
of two texts is the number of n-grams that both have over the geometric mean of their set sizes, within the n-grams of the
landmarks. Landmarks are labelled texts; ``K(x, L) @ A`` gives a score for each language, with ``A`` from ridge regression in
the Nystroem space. Scoring is presence matrices times landmark matrices and one more product, for each chunk of at most ``ROWS``
whole texts; n-grams are taken in blocks of such a width that neither matrix has more than ``2 * CELLS`` cells.

Learning: of every value of lang, ``per_lang`` rows at most (whole texts), of these ``landmarks`` as landmarks. Tasks work out
n-gram sets and kernel rows; what comes to the driver is the landmarks' sets and a number for each landmark and training row:
it grows with the number of languages, not with the corpus or the length of texts.

Rejection (``keep_known`` only): a text less than ``FAMILIAR`` of whose n-grams (repeated ones counted) occur in any
landmark is in no known language, as its kernels rest on chance; so is a text without a letter.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is every text if nothing could be learned
(no labelled rows). Texts of any length count whole. Repeated rows get equal answers, ties go to the first language by name.
Rows with a null language are never learned from. An input column named like an output column is replaced. An empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, held_out, map_chunks

ORDERS = (2, 3, 4)
BITS, ROWS, CELLS = 20, 256, 1 << 22
FAMILIAR = 0.25
LETTER = regex.compile(r"\p{L}")


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A hash of ``BITS`` bits of the n bytes at each position of data (the order is part of it)."""
    code = np.full(len(data) - n + 1, n, np.uint32)
    for k in range(n):
        code = code * np.uint32(0x01000193) ^ data[k : len(data) - n + 1 + k].astype(np.uint32)
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, lower-cased, each followed by zero bytes (no landmark has an n-gram with one), and where they begin."""
    pad = b"\0" * max(ORDERS)
    begins = np.cumsum([0] + [len(x) + len(pad) for x in texts])
    return np.frombuffer(pad.join([*texts, b""]).lower(), np.uint8), begins


def sets(texts: list[bytes]) -> list[np.ndarray]:
    """The n-gram set of each text, sorted."""
    data, begins = joined(texts)
    out = []
    for a, b in zip(begins[:-1], begins[1:] - max(ORDERS), strict=True):
        found = [gram_hashes(data[a:b], n)[~(np.lib.stride_tricks.sliding_window_view(data[a:b], n) == 0).any(axis=1)] for n in ORDERS if b - a >= n]
        out.append(np.unique(np.concatenate([np.empty(0, np.uint32), *found])).astype(np.int32))
    return out


class Model:
    """table: n-gram hash to feature, the number of features for none; at, marks: each feature's landmarks; weights: landmark to
    class, the last row a constant."""

    def __init__(self, langs: list[str], landmarks: list[np.ndarray], sharp: float = 6.0):
        self.langs, self.sharp, self.n, self.weights = langs, sharp, len(landmarks), None
        code = np.concatenate([np.empty(0, np.int32), *landmarks])
        known, feature = np.unique(code, return_inverse=True)
        self.table = np.full(1 << BITS, len(known), np.int32)
        self.table[known] = np.arange(len(known), dtype=np.int32)
        order = np.argsort(feature, kind="stable")
        self.marks = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in landmarks])[order]
        self.at = np.searchsorted(feature[order], np.arange(len(known) + 1))
        self.scale = 1 / np.sqrt(np.maximum(np.array([len(x) for x in landmarks], np.float32), 1))

        self.width = max(1, min(len(known), CELLS // max(1, self.n), 2 * CELLS // ROWS))
        self.dense: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"dense": {}}

    def block(self, b: int) -> np.ndarray:
        """The landmarks that have the n-grams of a block, and a last row for n-grams of none; the last one made is kept."""
        if b not in self.dense:
            at = self.at[b * self.width : (b + 1) * self.width + 1]
            m = np.zeros((self.width + 1, self.n), np.float32)
            m[np.repeat(np.arange(len(at) - 1), np.diff(at)), self.marks[at[0] : at[-1]]] = 1
            self.dense = {b: m}
        return self.dense[b]

    def kernel(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, landmarks), and the share of each text's n-grams (repeated ones counted) that some landmark has."""
        out, count, hits = np.zeros((len(texts), self.n), np.float32), np.zeros(len(texts)), np.zeros(len(texts))
        data, begins = joined(texts)
        size = np.diff(begins) - max(ORDERS)
        row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(begins))
        known, blocks = len(self.at) - 1, -(-(len(self.at) - 1) // self.width)
        found = []
        for n in ORDERS:
            f = self.table[gram_hashes(data, n)]
            hits += np.add.reduceat(f < known, begins[:-1])
            found.append((row[: len(f)], f))
        if blocks > 1:
            r, f = (np.concatenate(x) for x in zip(*found, strict=True))
            r, f = r[f < known], f[f < known]
            order = np.argsort((f // self.width).astype(np.uint16), kind="stable")
            r, f = r[order], f[order]
            ends = np.searchsorted(f // self.width, np.arange(blocks + 1))
            found = [(r[i:j], f[i:j] - b * self.width) for b, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
        x = np.zeros((len(texts), self.width + 1), np.float32)
        for b in range(blocks):
            for r, f in found if blocks == 1 else found[b : b + 1]:
                x.reshape(-1)[r * np.int64(self.width + 1) + f] = 1
            x[:, self.width] = 0  # n-grams of no landmark
            out += x @ self.block(b)
            count += x.sum(axis=1)
            if b + 1 < blocks:
                x[:] = 0
        total = sum(np.maximum(size - n + 1, 0) for n in ORDERS)
        return out * self.scale / np.sqrt(np.maximum(count, 1))[:, None].astype(np.float32), hits / np.maximum(total, 1)

    def solve(self, kernel: np.ndarray, labels: np.ndarray, landmarks: np.ndarray, ridge: float = 1e-2) -> None:
        """Weights from the landmarks' own kernel and the training rows' kernel and classes; each class has equal weight."""
        values, vectors = np.linalg.eigh(landmarks.astype(np.float64))
        half = vectors / np.sqrt(np.maximum(values, 1e-6))  # K^-1/2 up to a rotation
        z = np.column_stack([kernel.astype(np.float64) @ half, np.ones(len(kernel))])
        y = np.where(labels[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        weight = (len(labels) / (len(self.langs) * np.bincount(labels, minlength=len(self.langs))))[labels, None]
        w = np.linalg.solve(z.T @ (z * weight) + ridge * len(labels) / 100 * np.eye(z.shape[1]), z.T @ (y * weight))
        self.weights = np.vstack([half @ w[:-1], w[-1:]]).astype(np.float32)

    def answer(self, texts: list[bytes]) -> dict:
        names, scores, reject = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
        if self.langs and texts:
            kernel, share = self.kernel(texts)
            decision = (kernel @ self.weights[:-1] + self.weights[-1]).astype(np.float64)
            z = decision * self.sharp
            e = np.exp(z - z.max(axis=1, keepdims=True))
            has = np.fromiter((bool(LETTER.search(x.decode("utf-8", "replace"))) for x in texts), bool, len(texts))
            names = np.where(has, np.array(self.langs, object)[z.argmax(axis=1)], names)
            scores = np.where(has, e.max(axis=1) / e.sum(axis=1), 0.0)
            reject = ~has | (share < FAMILIAR)
        return {"lang_pred": names, "score": scores, "rejected": reject}


def fit(docs: DataFrame, per_lang: int = 256, landmarks: int = 32) -> Model:
    """Learn from at most ``per_lang`` rows of each language (the smallest hash of doc_id in each of ``per_lang`` hash classes)."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(False)))
    key, part = F.xxhash64("doc_id"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(per_lang))
    keyed = rows.select("lang", "text", key.alias("k"), part.alias("part"))
    least = cut(keyed.groupBy("lang", "part").agg(F.min("k").alias("k")))  # a table whose size is known, so that Spark picks the join
    train = cut(keyed.join(least, ["lang", "part", "k"], "left_semi").select("lang", "k", "text").dropDuplicates(["lang", "k"]))
    ranked = train.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("k"))).where(F.col("rank") <= landmarks).drop("rank")
    got = map_chunks(ranked, ["text"], lambda texts: {"ids": sets(texts)}, "ids array<int>", ["lang", "k"]).toPandas().sort_values(["lang", "k"])
    langs = sorted(set(got["lang"]))
    model = Model(langs, [np.asarray(x, np.int32) for x in got["ids"]])
    if langs:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        kernels = map_chunks(train, ["text"], lambda texts: {"row": [x.tobytes() for x in shared.value.kernel(texts)[0]]}, "row binary", ["lang", "k"], rows=ROWS)
        rows = kernels.toPandas().sort_values(["lang", "k"], ignore_index=True)
        kernel = np.frombuffer(b"".join(rows["row"]), np.float32).reshape(-1, model.n)
        own = rows.reset_index().merge(got[["lang", "k"]].reset_index(drop=True).reset_index(names="mark"), on=["lang", "k"]).sort_values("mark")
        marks = kernel[own["index"].to_numpy()]
        model.solve(kernel, np.searchsorted(langs, rows["lang"]), (marks + marks.T) / 2)
    return model


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of 2^BITS numbers and the landmarks' sets
    return map_chunks(docs, ["text"], lambda texts: shared.value.answer(texts), "lang_pred string, score double, rejected boolean", keep, rows=ROWS)


def digest(docs: DataFrame) -> DataFrame:
    """The rows of the registered query."""
    model = fit(docs)
    return predict(docs, model, ["doc_id"]).select("doc_id", F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that no language can be given go (null, without a letter, or in no known language)."""
    model = fit(docs)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__ld_row")
    return predict(docs.select("text", row), model, ["__ld_row"]).where("NOT rejected").select("__ld_row.*")
