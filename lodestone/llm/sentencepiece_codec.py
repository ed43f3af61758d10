"""SentencePiece encoding and decoding in batches of whole texts, by a numpy Viterbi.

Space is written U+2581 and a text gets one in front, as the public piece files expect; there is no other
normalisation, so decoding gives back every text exactly. Words (a run of U+2581 and what follows up to the next run)
are looked at once a batch: words of equal length advance together, hashes of their substrings probe sorted arrays of
piece hashes, and vectorised maxima over the piece lengths store the backpointers. A word of over ``LONG`` characters (a
script without spaces) is cut first wherever no piece of two or more characters spans, which leaves the best path as it is.
A character that no piece covers becomes its UTF-8 bytes' pieces.

A unigram model's scores are log-probabilities and are used as they are. The public file here is a BPE model: its scores
are merge ranks, so a piece of rank r gets the log-probability of a Zipf law, -ln(r + ZIPF). The segmentation is thus the
best path under those scores, not the order of BPE merges.

Edge cases: null and empty texts have no ids and decode to the empty text; a literal U+2581 goes by bytes and comes back;
texts of any length; repeated rows give equal ids; a clashing input column is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import lookup, map_chunks, splitmix, spread

SPACE, LITERAL = 0x2581, 0x110000  # a space; a U+2581 of the text itself
ZIPF = 10.0
LONG = 64
FILTER = 19
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Vocabulary:
    """Pieces as sorted hashes by length, with scores, and their bytes for decoding. A few MB; bounded by the piece file."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        """kinds: 'piece', 'byte' or 'other' (control, unknown, unused)."""
        real = [i for i, k in enumerate(kinds) if k == "piece" and pieces[i]]
        assert all("▁" not in pieces[i].lstrip("▁") for i in real), "a piece crosses a word's start"
        ranks = np.array([scores[i] for i in real])
        if len(ranks) and np.all(ranks <= 0) and np.all(ranks == np.round(ranks)):
            ranks = -np.log(ZIPF - ranks)
        self.worst = float(ranks.min()) - 10 if len(ranks) else -10.0
        self.byte_ids = np.zeros(256, np.int32)
        blobs = []
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == "byte":
                self.byte_ids[int(p[3:5], 16)] = i
                blobs.append(bytes([int(p[3:5], 16)]))
            else:
                blobs.append(p.replace("▁", " ").encode() if k == "piece" else b"")
        self.blob = np.frombuffer(b"".join(blobs), np.uint8)
        self.blob_len = np.array([len(x) for x in blobs], np.int64)
        self.blob_at = np.cumsum(self.blob_len) - self.blob_len
        self.by_len: dict[int, tuple[np.ndarray, ...]] = {}
        for n in sorted({len(pieces[i]) for i in real}):
            at = [j for j, i in enumerate(real) if len(pieces[i]) == n]
            codes = np.array([[ord(c) for c in pieces[real[j]]] for j in at], np.uint64)
            keys = (splitmix(codes) * powers(BASE, n)).sum(axis=1, dtype=np.uint64)
            order = np.argsort(keys)
            assert len(np.unique(keys)) == len(keys), "two pieces of one hash"
            likely = np.zeros(1 << FILTER, bool)  # most substrings end here
            likely[keys >> np.uint64(64 - FILTER)] = True
            self.by_len[n] = keys[order], np.array([real[j] for j in at], np.int32)[order], ranks[at][order], likely

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        kinds = ["byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "piece" for i in ids]
        return Vocabulary([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], kinds)

    def best_paths(self, grams: np.ndarray, inv: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words of n characters: ids (-1: unknown) and the character of each piece, right-aligned; counts."""
        m, longest = len(starts), min(n, max(self.by_len, default=1))
        score = {k: np.full((n - k + 1, m), -np.inf) for k in range(1, longest + 1)}
        ids = {k: np.full((n - k + 1, m), -1, np.int32) for k in range(1, longest + 1)}
        score[1][:] = self.worst
        for k in range(1, longest + 1):
            if k in self.by_len:
                at = starts[None, :] + np.arange(n - k + 1)[:, None]
                keys, piece_ids, scores, likely = self.by_len[k]
                probe = ((grams[at + k] - grams[at]) * inv[at]).ravel()
                cell = np.flatnonzero(likely[probe >> np.uint64(64 - FILTER)])
                found = lookup(keys, probe[cell])
                cell, found = cell[found >= 0], found[found >= 0]
                score[k].reshape(-1)[cell], ids[k].reshape(-1)[cell] = scores[found], piece_ids[found]
        best, back = np.zeros((n + 1, m)), np.zeros((n + 1, m), np.int16)
        for j in range(1, n + 1):
            best[j] = -np.inf
            for k in range(min(longest, j), 0, -1):  # of equal sums the longest last piece stays
                v = best[j - k] + score[k][j - k]
                np.putmask(back[j], v > best[j], k)
                np.maximum(best[j], v, out=best[j])
        out, where = np.full((m, n), -1, np.int32), np.zeros((m, n), np.int64)
        pos, count, rows = np.full(m, n), np.zeros(m, np.int64), np.arange(m)
        while len(rows):
            k = back[pos[rows], rows].astype(np.int64)
            pos[rows] -= k
            count[rows] += 1
            where[rows, n - count[rows]] = pos[rows]
            for size in np.unique(k):
                r = rows[k == size]
                out[r, n - count[r]] = ids[int(size)][pos[r], r]
            rows = rows[pos[rows] > 0]
        return out, where, count

    def cuts(self, grams: np.ndarray, inv: np.ndarray, start: int, end: int) -> np.ndarray:
        """Places inside a word that no piece of two or more characters spans."""
        n = end - start
        over = np.zeros(n + 1, np.int32)
        for k, (keys, _, _, likely) in self.by_len.items():
            if 2 <= k <= n:
                probe = (grams[start + k : end + 1] - grams[start : end - k + 1]) * inv[start : end - k + 1]
                cell = np.flatnonzero(likely[probe >> np.uint64(64 - FILTER)])
                cell = cell[lookup(keys, probe[cell]) >= 0]
                over[cell + 1] += 1
                over[cell + k] -= 1
        return start + 1 + np.flatnonzero(np.cumsum(over)[1:n] == 0)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin and end."""
        if not any(texts):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        decoded = [" " + x.decode("utf-8", "replace") if x else "" for x in texts]
        lens = np.fromiter(map(len, decoded), np.int64, len(decoded))
        codes = np.frombuffer("".join(decoded).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        codes[codes == SPACE] = LITERAL
        codes[codes == 0x20] = SPACE
        begins = np.cumsum(lens) - lens
        first = np.zeros(len(codes), bool)
        space = codes == SPACE
        first[1:] = space[1:] & ~space[:-1]
        first[begins[lens > 0]] = True
        inv = powers(INVERSE, len(codes) + 1)
        grams = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(splitmix(codes) * powers(BASE, len(codes)), out=grams[1:])
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(codes))
        long = np.flatnonzero(ends - starts > LONG)
        if len(long):
            starts = np.sort(np.concatenate([starts, *[self.cuts(grams, inv, starts[i], ends[i]) for i in long]]))
            ends = np.append(starts[1:], len(codes))
        size = ends - starts
        key = (grams[ends] - grams[starts]) * inv[starts] + splitmix(size)
        _, one, inverse = np.unique(key, return_index=True, return_inverse=True)
        flat, counts = [], np.zeros(len(one), np.int64)
        order = np.argsort(size[one], kind="stable")
        cuts = np.flatnonzero(np.diff(size[one][order])) + 1
        for group in np.split(order, cuts):
            n = int(size[one[group[0]]])
            for part in np.array_split(group, max(1, len(group) * n // 200_000)):
                at = starts[one[part]]
                ids, where, count = self.best_paths(grams, inv, at, n)
                used = np.arange(n)[None, :] >= n - count[:, None]
                word = np.repeat(np.arange(len(part)), count)
                ids, where = ids[used], where[used]
                unknown = np.flatnonzero(ids < 0)
                if len(unknown):
                    code = codes[at[word[unknown]] + where[unknown]]
                    code[code == LITERAL] = SPACE
                    kinds, which = np.unique(code, return_inverse=True)
                    spelt = [self.byte_ids[np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8)] for c in kinds]
                    width = np.ones(len(ids), np.int64)
                    width[unknown] = np.array([len(x) for x in spelt])[which]
                    filled = np.repeat(ids, width)
                    filled[filled < 0] = np.concatenate([spelt[w] for w in which])
                    ids, count = filled, np.bincount(word, weights=width, minlength=len(part)).astype(np.int64)
                flat.append(ids)
                counts[part] = count
        ordered = np.concatenate([np.empty(0, np.int64), *[p for group in np.split(order, cuts) for p in np.array_split(group, max(1, len(group) * int(size[one[group[0]]]) // 200_000))]]).astype(np.int64)
        at = np.zeros(len(one), np.int64)
        at[ordered] = np.cumsum(counts[ordered]) - counts[ordered]
        tokens = np.concatenate(flat)[spread(at[inverse], counts[inverse])]
        upto = np.append(0, np.cumsum(counts[inverse]))
        return tokens, upto[np.searchsorted(starts, np.append(begins, len(codes)))]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids given as by encode."""
        ids = ids.astype(np.int64)
        data = self.blob[spread(self.blob_at[ids], self.blob_len[ids])].tobytes()
        at = np.append(0, np.cumsum(self.blob_len[ids]))[ends]
        return [data[a + (data[a : a + 1] == b" ") : z].decode("utf-8", "replace") if z > a else "" for a, z in zip(at[:-1], at[1:], strict=True)]


def _columns(ids: np.ndarray, ends: np.ndarray) -> dict:
    return {"token_ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), "n_tokens": np.diff(ends)}


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns ``keep``) with token_ids (array of int) and n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the piece file
    return map_chunks(docs, [text], lambda texts: _columns(*shared.value.encode(texts)), "token_ids array<int>, n_tokens long", keep)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """df (or its columns ``keep``) with decoded_text; null ids decode to the empty text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(rows: list[bytes], lists: pa.Array) -> dict:
        arrays = [np.asarray(x or [], np.int32) for x in lists.to_pylist()]
        ends = np.append(0, np.cumsum([len(x) for x in arrays])).astype(np.int64)
        return {"decoded_text": shared.value.decode(np.concatenate([np.empty(0, np.int32), *arrays]), ends)}

    sized = df.withColumn("__ld_size", F.expr(f"cast(repeat('x', size(`{ids}`)) as binary)"))  # a row counts as many bytes as it has ids
    return map_chunks(sized, ["__ld_size", ids], run, "decoded_text string", df.columns if keep is None else keep)


def transcode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """encode and decode in one Python stage: docs (or ``keep``) with token_ids, n_tokens, decoded_text and round_trip."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(texts: list[bytes]) -> dict:
        ids, ends = shared.value.encode(texts)
        back = shared.value.decode(ids, ends)
        return _columns(ids, ends) | {"decoded_text": back, "round_trip": [a.encode() == b for a, b in zip(back, texts, strict=True)]}

    return map_chunks(docs, [text], run, "token_ids array<int>, n_tokens long, decoded_text string, round_trip boolean", keep)


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Ids of every whole text and whether they decode to it exactly."""
    out = transcode(docs, Vocabulary.load(path), keep=["doc_id"])
    return out.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded_text", 256).alias("decoded_sha256"), "round_trip")
