"""SentencePiece encoding and decoding with N-best segmentation.

The pieces of a vocabulary that match a text span a lattice over its characters.  A forward Viterbi pass gives every position the score
of the best way to it; these scores are exact heuristics for an A* search that runs backward from the end, so its
first N arrivals at the start are the N best segmentations, best first.

The lattice falls apart wherever no piece crosses: before a space that follows something else, and around a line
feed, if the vocabulary has no such piece.  A text's best segmentation is then the chain of its segments' best ones, and its N best
differ from that only in the N - 1 segments whose runner-up costs least.  So the forward pass, with each segment's cheapest deviation, runs
over the distinct segments of a batch, many at a time in numpy; the A* search runs on the few segments that can
contribute.  The result is that of one search over the whole lattice.

The score of a piece is its log-probability.  A unigram model's file has it.  The "scores" of a BPE model's file are the ranks of its merges, which
can't be added up; pieces are merged by frequency, so there a piece of rank r gets the log-probability of Zipf's law with Mandelbrot's
shift, -log(r + SHIFT) - log(sum of 1 / (r' + SHIFT) over all pieces).  Nothing is trained.  Scores are whole multiples of 2**-20, so that sums
are exact in any order.  Segmentations by such scores are the likeliest ones, not those that merging would give.

Texts are taken as they are, with one space before them (dropped again by decoding).  A character without a piece is
spelt in byte pieces at the price of the lowest proper score less 10.  Of segmentations with equal scores, the one with the longer
last piece comes first.  Decoding gives back any text exactly.

Defined cases: a null text has null results and counts as decoded; an empty text is the single prefix space; equal texts get equal pieces;
an empty table gives an empty result; further columns are kept by encode(..., keep=True), except those named like a result.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Numbers, mapped, packed, quoted, unpacked

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The shift in Zipf's law for the pieces of a BPE model.
SHIFT = 2.7
#: Segments longer than this are searched one by one.
LONG = 40
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
FAR = -1e18


def log_probabilities(scores: np.ndarray, proper: np.ndarray) -> np.ndarray:
    """The log-probability of each piece from a model's scores; proper: the ids of pieces that stand for text.  Scores that are whole
    numbers, all different, are ranks; pieces that merging never gives (-1e9) have none and keep that score."""
    proper = proper[scores[proper] > -1e8]
    own = scores[proper]
    if len(own) and (own == np.round(own)).all() and len(np.unique(own)) == len(own):
        weight = 1 / (np.argsort(np.argsort(-own)) + 1 + SHIFT)
        scores = scores.copy()
        scores[proper] = np.log(weight / weight.sum())
    return np.round(scores * (1 << 20)) / (1 << 20)


class Vocabulary:
    """The pieces of a SentencePiece model, with a hash table that numpy can look many substrings up in."""

    def __init__(self, proto: bytes):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = model.get_piece_size()
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes, self.byte_ids = [b""] * n, [-1] * 256
        for i in range(n):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(p[3:5], 16)], self.bytes[i] = i, bytes([int(p[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                p = p.replace("▁", " ")
                self.pieces[p], self.bytes[i] = (i, model.get_score(i)), p.encode()
        self.scores = log_probabilities(np.array([model.get_score(i) for i in range(n)]), np.array([i for i,
            _ in self.pieces.values()], np.int64))
        self.pieces = {p: (i, float(self.scores[i])) for p, (i, _) in self.pieces.items()}
        self.unknown = min((s for _, s in self.pieces.values() if s > -1e8), default=0.0) - 10
        self.longest = max(map(len, self.pieces), default=1)
        self.cut = not any(" " in p.lstrip(" ") or "\n" in p and p != "\n" for p in self.pieces)
        self.segment = re.compile(r" *[^ \n]+|\n| +").findall if self.cut else lambda t: [t]
        self._build()

    def _build(self) -> None:
        """Two tables; each piece has its place in one of them (cuckoo hashing)."""
        keys = {self._hash(p): i for p, (i, _) in self.pieces.items()}
        assert len(keys) == len(self.pieces)
        self.shift = np.uint64(64 - max(4, (len(keys) * 4).bit_length()))
        size = 1 << (64 - int(self.shift))
        place = lambda k, t: (k * int(MIX[t]) & 0xFFFFFFFFFFFFFFFF) >> int(self.shift)
        slots: list[list] = [[None] * size, [None] * size]
        for item in keys.items():
            t = 0
            for _ in range(500):
                at = place(item[0], t)
                item, slots[t][at] = slots[t][at], item
                if item is None:
                    break
                t = 1 - t
            else:
                raise ValueError("pieces don't fit in the table")
        self.keys = [np.array([x[0] if x else 0 for x in s], np.uint64) for s in slots]
        self.ids = [np.array([x[1] if x else -1 for x in s], np.int32) for s in slots]

    @staticmethod
    def _hash(p: str) -> int:
        h, b = 0, 1
        for c in p:
            h = h + (ord(c) + 1) * b & 0xFFFFFFFFFFFFFFFF
            b = b * int(BASE) & 0xFFFFFFFFFFFFFFFF
        return h

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashed substrings, -1 for none."""
        a, b = (h * MIX[0]) >> self.shift, (h * MIX[1]) >> self.shift
        return np.where(self.keys[0][a] == h, self.ids[0][a], np.where(self.keys[1][b] == h, self.ids[1][b],
            np.int32(-1)))

    def spelt(self, c: str) -> list[int]:
        return [self.byte_ids[b] for b in c.encode()]

    def edges(self, s: str) -> list[list[tuple[int, int, float]]]:
        """For each end, the (start, id, score) of what can stand there, longest first; id -1 is a spelt character."""
        out: list[list[tuple[int, int, float]]] = [[]]
        get, longest, unknown = self.pieces.get, self.longest, self.unknown
        for e in range(1, len(s) + 1):
            own = [(i, *x) for i in range(max(0, e - longest), e) if (x := get(s[i:e]))]
            if not own or own[-1][0] != e - 1:
                own.append((e - 1, -1, unknown))
            out.append(own)
        return out

    def nbest(self, s: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of s, as (score, ids): forward Viterbi, backward A*."""
        edges = self.edges(s)
        best = [0.0] * (len(s) + 1)
        for e in range(1, len(s) + 1):
            best[e] = max(best[i] + x for i, _, x in edges[e])
        agenda: list = [(-best[-1], 0, len(s), 0.0, None)]
        out, turn = [], 0
        while agenda and len(out) < n:
            _, _, at, behind, path = heapq.heappop(agenda)
            if not at:
                ids, total = [], behind
                while path:
                    (start, piece), path = path
                    ids += [piece] if piece >= 0 else self.spelt(s[start])
                out.append((total, ids))
                continue
            for start, piece, x in reversed(edges[
                at]):  # among equals the longest goes first, and straight on to the start
                turn -= 1
                heapq.heappush(agenda, (-(best[start] + x + behind), turn, start, x + behind, ((start, piece), path)))
        return out

    def forward(self, segments: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
        """Ids of the best segmentation of each segment, its score, and what its cheapest deviation costs (inf: there is none)."""
        ids: list = [None] * len(segments)
        score, gap = np.zeros(len(segments)), np.full(len(segments), np.inf)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        slow = np.flatnonzero(lengths > LONG).tolist()
        order = np.argsort(lengths, kind="stable")
        bounds = np.searchsorted(lengths[order], np.arange(1, LONG + 2))
        for n in range(1, LONG + 1):
            own = order[bounds[n - 1] : bounds[n]]
            for at in range(0, len(own), 20_000):
                slow += self._forward(segments, own[at : at + 20_000], n, ids, score, gap)
        for k in slow:
            found = self.nbest(segments[k], 2)
            ids[k], score[k] = np.array(found[0][1], np.int32), found[0][0]
            gap[k] = found[0][0] - found[1][0] if len(found) > 1 else np.inf
        return ids, score, gap

    def _forward(self, segments, own, n, ids, score, gap) -> list[int]:
        k = len(own)
        codes = np.frombuffer("".join([segments[i] for i in own.tolist()]).encode("utf-32-le"), np.uint32).reshape(k,
            n).T.astype(np.uint64) + np.uint64(1)
        best = np.full((n + 1, k), FAR)
        second = np.full((n + 1, k), FAR)
        back, piece = np.zeros((n + 1, k), np.int8), np.zeros((n + 1, k), np.int32)
        best[0] = 0
        hashes, power, strange = [codes[i].copy() for i in range(n)], BASE, np.zeros(k, bool)
        found: dict[tuple[int, int], np.ndarray] = {}
        for size in range(1, min(n, self.longest) + 1):
            for i in range(n - size + 1):
                if size > 1:
                    hashes[i] += codes[i + size - 1] * power
                found[i, i + size] = self.lookup(hashes[i])
            if size > 1:
                power = np.uint64(int(power) * int(BASE) & 0xFFFFFFFFFFFFFFFF)
        for e in range(1, n + 1):
            b, s2 = best[e], second[e]
            for i in range(max(0, e - self.longest), e):
                got = found.pop((i, e))
                x = np.where(got >= 0, best[i] + self.scores[got], FAR)
                if i == e - 1:
                    strange |= got < 0
                better = x > b
                np.maximum(s2, np.minimum(x, b), out=s2)
                b[better] = x[better]
                back[e][better] = i
                piece[e][better] = got[better]
        at, pick = np.full(k, n), np.arange(k)
        delta, steps = best - second, []
        least = np.full(k, np.inf)
        while at.any():
            on = at > 0
            d = delta[at, pick]
            least = np.where(on & (d < -FAR / 2), np.minimum(least, d), least)
            steps.append(np.where(on, piece[at, pick], -1))
            at = np.where(on, back[at, pick], 0)
        grid = np.stack(steps[::-1], 1)
        used = grid >= 0
        flat, ends = grid[used], np.cumsum(used.sum(1))
        parts = np.split(flat, ends[:-1])
        for j, i in enumerate(own.tolist()):
            ids[i] = parts[j]
        score[own], gap[own] = best[n], least
        return own[strange].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of a whole segmentation, without the space before it."""
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode("utf-8", "replace")


@lru_cache(2)
def vocabulary(proto: bytes) -> Vocabulary:
    return Vocabulary(proto)


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def runners_up(v: Vocabulary, segments: list[str], gaps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n: int,
    nbest) -> list[tuple[float, list]]:
    """What the second to nth best segmentation of a text cost more than the best, and their edits (at, drop, ids), in text order."""
    k = min(n - 1, len(gaps))
    if k <= 0:
        return []
    pick = np.argpartition(gaps, k - 1)[:k] if k < len(gaps) else np.arange(len(gaps))
    edge = gaps[pick].max()
    below = np.flatnonzero(gaps < edge)
    pick = np.concatenate([below, np.flatnonzero(gaps == edge)[: k - len(
        below)]])  # the first of those that cost the same
    combos: list[tuple[float, list]] = [(0.0, [])]
    for j in sorted(pick[np.isfinite(gaps[pick])].tolist()):
        found = nbest(segments[j], n)
        top = found[0][0]
        edit = (int(starts[j]), int(sizes[j]))
        combos = sorted(((c + top - x, edits + [(*edit, ids)] * bool(r)) for c, edits in combos for r, (x,
            ids) in enumerate(found)), key=lambda x: x[0])[:n]
    return combos[1:]


def encode_texts(v: Vocabulary, texts: list[str | None], n: int) -> tuple[pa.Array, list[float | None], list]:
    """Ids (lists), scores, and alternatives of each text."""
    numbers, per_text = Numbers(), []
    for t in texts:
        if t is not None:
            own = v.segment(" " + t)
            per_text.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
    segments = list(numbers)
    ids, score, gap = v.forward(segments)
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(counts)])[:-1]
    cache: dict[str, list] = {}

    def nbest(s: str, k: int) -> list:
        if s not in cache:
            cache[s] = v.nbest(s, k)
        return cache[s]

    found = iter(per_text)
    values, ends, scores, more = [], [0], [], []
    for t in texts:
        if t is None:
            ends.append(ends[-1])
            scores.append(None)
            more.append(None)
            continue
        own = next(found)
        sizes = counts[own]
        starts = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        values.append(flat[np.repeat(offsets[own] - starts, sizes) + np.arange(total)])
        ends.append(ends[-1] + total)
        best = float(score[own].sum())
        scores.append(best)
        more.append([{"score": best - c, "edits": [{"at": a, "drop": d, "ids": x} for a, d, x in edits]} for c,
            edits in runners_up(v, _Lazy(segments, own), gap[own], starts, sizes, n, nbest)])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values
        else np.zeros(0, np.int32), pa.int32()))
    return lists, scores, more


class _Lazy:
    """segments[own[j]] for j."""

    def __init__(self, segments, own):
        self.segments, self.own = segments, own

    def __getitem__(self, j):
        return self.segments[self.own[j]]


ALTERNATIVES = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("at", pa.int32()), ("drop",
    pa.int32()), ("ids", pa.list_(pa.int32()))])))]))
RESULT = "n_tokens long, token_ids array<int>, score double, alternatives array<struct<score:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>, decoded boolean"
NAMES = ["n_tokens", "token_ids", "score", "alternatives", "decoded"]


def encode(docs: DataFrame, n_best: int = 3, model: str = MODEL, keep: bool = False) -> DataFrame:
    """Per row: doc_id (with keep: all columns of docs), the best ids, their score, the other n_best - 1 segmentations as edits of the best (replace
    `drop` ids from `at` on), and whether decoding the ids gave the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model))  # a vocabulary file: some MB at most
    columns = [c for c in docs.columns if c not in NAMES]
    docs = packed(docs.select(*map(quoted, columns)), ("doc_id", "text")) if keep else docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kept = docs.columns if keep else ["doc_id"]
    schema = T.StructType([f for f in docs.schema if f.name in kept] + T._parse_datatype_string(RESULT).fields)

    def work(part: pa.RecordBatch):
        v = vocabulary(shared.value)
        texts = part.column("text").to_pylist()
        ids, scores, more = encode_texts(v, texts, n_best)
        missing = pa.array([t is None for t in texts])
        ends, values = ids.offsets.to_numpy(), ids.values.to_numpy()
        right = [t is None or v.decode(values[a:b].tolist()) == t for t, a, b in zip(texts, ends[:-1].tolist(),
            ends[1:].tolist(), strict=True)]
        counts = pa.array(np.diff(ends), pa.int64(), mask=missing.to_numpy(zero_copy_only=False))
        if missing.true_count:
            ids = pa.array([None if t is None else x for t, x in zip(texts, ids.to_pylist(), strict=True)], ids.type)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), counts, ids, pa.array(scores, pa.float64()),
            pa.array(more, ALTERNATIVES), pa.array(right)], names=[*kept, *NAMES])

    found = mapped(docs, work, schema, limit=4 << 20)
    return unpacked(found, [*columns, *NAMES], ("doc_id", "text", *NAMES)) if keep else found


def decode(tokens: DataFrame, model: str = MODEL) -> DataFrame:
    """Per row of tokens: doc_id and the text that token_ids spell (null for null)."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_model(model))
    tokens = tokens.select("doc_id", "token_ids")

    def run(batches):
        for part in batches:
            v = vocabulary(shared.value)
            texts = [None if x is None else v.decode(x) for x in part.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id",
                "text"])

    return tokens.mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, text string")
