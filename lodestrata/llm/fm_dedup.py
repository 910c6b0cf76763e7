"""Substring dedup: passages of `window` words that start anywhere else too, by FM-indexes.

A shard's index is an FM-index over words: the Burrows-Wheeler transform of its passages, in a wavelet tree shaped by
a Shannon code (so that it takes about the entropy of the words), with bit ranks from packed words and counts.  Passages of documents stream
through it backward: the interval of the words read so far shrinks as another word is put in front; as long as it holds two positions, what
has been read occurs twice.  These matching statistics, cut at the threshold, give the intervals in which every window is repeated.

What meets in a shard.  All windows with the same words must, and no document can visit every shard of a large corpus.  So a window is
dealt by its minimizer, the smallest hash of its GRAM-word runs, a value of its words alone; neighbouring windows with the same
minimizer travel as one segment.  Most minimizers occur once in the corpus, and so do their windows: counting them first leaves out
everything but candidates.  Equal segments travel once, with their number: two of them are two passages of the index, and more than two tell
nothing more.  A minimizer with more than HOT different segments (the edge of a very common passage) would fill a shard: its windows are dealt
one by one, by the hash of all their words, those that occur once left out by a count (there the count decides, and the search confirms).  A shard holds about SHARD_WORDS words, whatever the
corpus's size; runs of RUN words that it holds once cut its segments to the pieces in which something can recur, before these are indexed
and searched.

A filter of FILTER_BITS bits for each repeated minimizer, 2**MOST_FILTER_BITS at most, comes to the driver and goes to the tasks; it only spares
work: where it is full, more segments travel, and are found to occur once.  Words are compared by 64-bit hashes of all their letters, segments and
crowded windows on their way by 128-bit ones.

Defined cases: a null text counts as empty; a text with fewer words than a window loses nothing; of equal texts, and of rows that occur twice, each loses
all windows; a window that recurs within its own text is repeated; an empty table gives an empty result; further columns, whatever their names, are not
looked at by passages() and come through stripped_rows() unharmed; strip(..., keep=True) keeps them except those named like a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _mix as mixed
from .common import chunks, mapped, materialize, quoted, release, utf8, word_hashes

WINDOW, GRAM, HOT, SHARD_WORDS, FILTER_BITS, MOST_FILTER_BITS = 35, 12, 2000, 1_000_000, 16, 28
#: After a miss, whether so many words behind it are unique is tried first.
PROBE = 8
#: Windows that one lane of the search looks for.
LANE = 128
#: Words in a row that must stand twice in a shard wherever a window can recur.
RUN = 4
P1, P2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


# ---------------------------------------------------------------- FM-index


def suffix_array(text: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Order of the suffixes of text (numbers from 1; 0 at stops, each of which sorts as a symbol of its own), by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64) + len(stops)
    rank[stops] = np.arange(len(stops))
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        sorted_rank = rank[order]
        new = np.ones(n, bool)
        if width == 1:
            new[1:] = sorted_rank[1:] != sorted_rank[:-1]
        else:
            k = key[order]
            new[1:] = k[1:] != k[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        tail = np.zeros(n, np.int64)
        tail[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + tail
        order = np.argsort(key)
        width *= 2


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)

    def rank(self, p: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = p >> 6
        mask = (np.uint64(1) << (p & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletTree:
    """Rank of any symbol up to any position, over symbols 0..sigma-1 in a tree shaped by their Shannon code."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        n = len(symbols)
        freq = np.bincount(symbols, minlength=sigma)
        length = np.ceil(np.log2(n / np.maximum(freq, 1))).astype(np.int64)
        length = np.maximum(np.where((1 << length) * freq < n, length + 1, length),
            1)  # 2**length >= n / freq, in whole numbers
        self.depth = depth = int(length[freq > 0].max()) if n else 1
        length = np.minimum(length, depth)
        order = np.lexsort((np.arange(sigma), length))
        order = order[freq[order] > 0]
        share = 1 << (depth - length[order])
        code = np.zeros(sigma, np.int64)
        code[order] = np.cumsum(share) - share  # canonical: left-aligned
        self.length, self.code, self.freq = length, code, freq
        self.start = np.zeros((depth, sigma), np.int32)
        self.ones = np.zeros((depth, sigma), np.int32)
        self.levels: list[Bits] = []
        here = symbols
        for level in range(depth):
            bit = (code[here] >> (depth - 1 - level)) & 1
            bits = Bits(bit)
            self.levels.append(bits)
            node = code[here] >> (depth - level) if level else np.zeros(len(here), np.int64)
            first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(here) else np.zeros(0,
                np.int64)
            inside = np.flatnonzero((freq > 0) & (length > level))
            at = np.searchsorted(node[first], code[inside] >> (depth - level)) if level else np.zeros(len(inside),
                np.int64)
            begin = first[at]
            self.start[level, inside], self.ones[level, inside] = begin, bits.rank(begin)
            # zeros before ones within each node, and on without the symbols that end here
            sizes = np.diff(np.concatenate([first, [len(here)]]))
            offset = np.repeat(first, sizes)
            ones = np.cumsum(bit) - bit
            before = ones - np.repeat(ones[first], sizes)
            zeros = np.repeat(sizes - np.add.reduceat(bit, first), sizes) if len(here) else before
            place = np.empty_like(here)
            place[np.where(bit == 1, offset + zeros + before, np.arange(len(here)) - before)] = here
            here = place[length[place] > level + 1]

    def rank(self, c: np.ndarray, p: np.ndarray) -> np.ndarray:
        """How often each symbol c occurs before position p."""
        pos = p.astype(np.int64)
        length, code = self.length[c], self.code[c]
        deepest = int(length.max()) if len(c) else 0
        for level in range(deepest):
            on = length > level
            start = np.where(on, self.start[level, c], 0)
            ones = self.levels[level].rank(np.where(on, start + pos, 0)) - self.ones[level, c]
            pos = np.where(on, np.where((code >> (self.depth - 1 - level)) & 1 == 1, ones, pos - ones), pos)
        return pos


class FMIndex:
    """Backward search over texts of numbers from 1."""

    def __init__(self, text: np.ndarray, stops: np.ndarray, sigma: int):
        order = suffix_array(text, stops)
        self.n = len(text)
        self.tree = WaveletTree(text[order - 1], sigma)
        self.smaller = np.concatenate([[0], np.cumsum(self.tree.freq)])[:-1]

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals after putting c in front."""
        both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo, hi])) + np.tile(self.smaller[c], 2)
        return both[: len(c)], both[len(c) :]


def repeated_windows(index: FMIndex, text: np.ndarray, begins: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """For each position of text, whether the window that starts there occurs twice in the index.  All passages [begin, end) are read in step, from their ends.

    While a passage's words so far occur twice, another is put in front.  At a miss at i, the words from i to j occur once.  If that is
    more than a window, the windows behind i are known and the one at i is next.  Otherwise no window from i or before to j or beyond recurs; if even
    the PROBE words from i on occur once, the next window to look at ends within them, else it ends one word earlier than this one."""
    found = np.zeros(len(text), bool)
    windows = np.maximum(ends - begins - window + 1, 0)
    lanes = -(-windows // LANE)  # long passages are read in several lanes, each for its own windows
    nth = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    first = np.repeat(begins, lanes).astype(np.int64) + nth * LANE
    j = np.minimum(first + LANE + window - 1, np.repeat(ends, lanes))
    i, lo, hi = j.copy(), np.zeros(len(j), np.int64), np.full(len(j), index.n, np.int64)
    probing, miss, resume = np.zeros(len(j), bool), np.zeros(len(j), np.int64), np.zeros(len(j), np.int64)
    while len(j):
        i -= 1
        lo, hi = index.extend(text[i], lo, hi)
        twice = hi - lo >= 2
        full = twice & ~probing & (j - i >= window)
        found[i[full]] = True
        # a miss while searching
        missed = ~twice & ~probing
        long = missed & (j - i > window)
        short = missed & ~long
        probe = short & (j - i > PROBE)
        plain = short & ~probe
        # the end of a probe
        unique = probing & ~twice
        common = probing & twice & (i == miss)
        new_j = np.where(long, i + window, np.where(plain, j - 1, np.where(unique, miss + PROBE - 1, np.where(common,
            resume - 1, j))))
        resume, miss = np.where(probe, j, resume), np.where(probe, i, miss)
        restart = long | plain | unique | common
        j = np.where(restart, new_j, j)
        i = np.where(restart, j, np.where(probe, i + PROBE, i))
        lo, hi = np.where(restart | probe, 0, lo), np.where(restart | probe, index.n, hi)
        probing = (probing & ~unique & ~common) | probe
        going = np.where(probing, True, (j - first >= window) & (i > first))
        if not going.all():
            first, j, i, lo, hi, probing, miss, resume = (x[going] for x in (first, j, i, lo, hi, probing, miss,
                resume))
    return found


# ---------------------------------------------------------------- segments


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """For each place the least of the span values from there on (not meant for the last places)."""
    h, width = h.copy(), 1
    while width * 2 <= span:
        h[: len(h) - width] = np.minimum(h[: len(h) - width], h[width:])
        width *= 2
    if width < span:
        h[: len(h) - (span - width)] = np.minimum(h[: len(h) - (span - width)], h[span - width :])
    return h


class Segments:
    """The segments of some texts: doc (place in the batch), value (minimizer), start, windows, and two hashes."""

    def __init__(self, texts: list[bytes], window: int):
        self.words, self.starts = w, starts = word_hashes(texts)
        n = np.diff(starts)
        gram = min(max(GRAM, window - 200), window)  # places are told apart modulo 256
        counts = np.maximum(n - window + 1, 0)
        total = int(counts.sum())
        ends = np.cumsum(counts)
        at = np.repeat(starts[:-1] - (ends - counts), counts) + np.arange(total)  # where windows start
        doc = np.repeat(np.arange(len(n)), counts)
        value, place, twice = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        if total:
            h = w.copy()
            for i in range(1, gram):
                h[: len(w) - i] = h[: len(w) - i] * np.uint64(P1) + w[i:]
            h, span, low = mixed(h) & ~np.uint64(255), window - gram + 1, np.arange(len(w),
                dtype=np.uint64) & np.uint64(255)
            first, last = _least(h | low, span)[at], _least(h | (np.uint64(255) - low), span)[at]
            value, place = mixed(first >> np.uint64(8)), (first & np.uint64(255)).astype(np.int64)
            twice = (first & np.uint64(255)) + (last & np.uint64(255)) != 255  # the least value stands in two places
        new = np.ones(total, bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        self.doc, self.value, self.at = doc[head], value[head], at[head]
        self.windows = np.diff(np.concatenate([head, [total]])).astype(np.int64)
        #: Whether a segment may hold a window twice: its minimizer stands in more than one place.
        self.own = (np.logical_or.reduceat(twice, head) | (np.minimum.reduceat(place,
            head) != np.maximum.reduceat(place, head))) if total else twice
        self.start = self.at - starts[self.doc]
        self.window = window

    def hashes(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the words [at, at + size), from sums of powers."""
        out = []
        for p, salt in ((P1, 0), (P2, 0xA0761D6478BD642F)):
            n = len(self.words)
            power, inverse, sums = np.full(n + 1, p, np.uint64), np.full(n + 1, pow(p, -1, 1 << 64),
                np.uint64), np.zeros(n + 1, np.uint64)
            power[0] = inverse[0] = 1
            power, inverse = np.cumprod(power), np.cumprod(inverse)
            sums[1:] = np.cumsum(mixed(self.words ^ np.uint64(salt)) * power[:n])
            out.append(mixed((sums[at + size] - sums[at]) * inverse[at] + size.astype(np.uint64) * np.uint64(P2))
                .view(np.int64))
        return out[0], out[1]


def _bits(values: DataFrame, most: int) -> np.ndarray:
    """A filter with a bit for each long in column v: FILTER_BITS bits a value or more, 2**most at most."""
    bits = max(10, min((FILTER_BITS * values.count()).bit_length(), most))
    at = F.col("v").bitwiseAND(F.lit((1 << bits) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int"))
    rows = values.select(at.alias("h")).select(F.shiftright("h", 6).alias("word"), bit.alias("b")).groupBy(
        "word").agg(F.bit_or("b").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def _in(filter_: np.ndarray, v: np.ndarray) -> np.ndarray:
    h = v & np.uint64(len(filter_) * 64 - 1)
    return (filter_[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def _take(part: pa.RecordBatch, name: str, doc: np.ndarray) -> pa.Array:
    return part.column(name).take(pa.array(doc, pa.int64()))


def recurring(text: np.ndarray, begins: np.ndarray, ends: np.ndarray, copies: np.ndarray,
    window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts passages, each there so many times, where RUN words in a row stand nowhere a second time, as no window over such a run can recur: what is left with
    a window's length, again and again until nothing falls away.  text holds numbers; returns begins and ends of the pieces, and the passage that each is from."""
    owner, run = np.arange(len(begins)), min(RUN, window)
    h = text.astype(np.uint64)
    for i in range(1, min(run, len(text))):
        h[: len(text) - i] = h[: len(text) - i] * np.uint64(P1) + text[i:].astype(np.uint64)
    while len(begins):
        size = ends - begins - run + 1  # runs that start in a piece
        at = np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        _, which = np.unique(h[at], return_inverse=True)
        good = np.bincount(which, weights=np.repeat(copies[owner], size))[which] > 1
        if good.all():
            break
        piece = np.repeat(np.arange(len(size)), size)
        edge = np.ones(len(good), bool)
        edge[1:] = (good[1:] != good[:-1]) | (piece[1:] != piece[:-1])
        first = np.flatnonzero(edge)
        last = np.append(first[1:], len(good))
        keep = good[first] & (last - first + run - 1 >= window)
        begins, ends, owner = at[first[keep]], at[last[keep] - 1] + run, owner[piece[first[keep]]]
    return begins, ends, owner


def search_shard(parts: list[pa.RecordBatch], window: int) -> pa.RecordBatch:
    """Repeated windows (spans of offsets, flat) of the different segments (v, s1, s2, n, words; n of each) in a shard.

    Pieces that segments have alike stand in the index twice and are searched once."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    words = rows.column("words").to_pylist()
    copies = np.minimum(rows.column("n").to_numpy(), 2)
    sizes = np.array([len(x) // 8 for x in words], np.int64)
    _, dense = np.unique(np.frombuffer(b"".join(words), np.uint64), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    begins, ends, owner = recurring(dense, starts, starts + sizes, copies, window)
    found = np.zeros(len(dense) + 1, bool)
    if len(begins):
        known, short = np.unique(np.concatenate([dense[a:b] for a, b in zip(begins.tolist(), ends.tolist(),
            strict=True)]), return_inverse=True)
        size = ends - begins
        at = np.cumsum(size) - size
        same: dict[bytes, list[int]] = {}
        for i, (a, b) in enumerate(zip(at.tolist(), (at + size).tolist(), strict=True)):
            same.setdefault(short[a:b].tobytes(), []).append(i)
        heads = np.array([g[0] for g in same.values()])
        twice = np.array([copies[owner[g]].sum() > 1 for g in same.values()])
        indexed = np.concatenate([heads, heads[twice]])
        stops = np.cumsum(size[indexed] + 1) - 1
        text, inside = np.zeros(int(stops[-1]) + 1, np.int64), np.ones(int(stops[-1]) + 1, bool)
        inside[stops] = False
        text[inside] = np.concatenate([short[at[i] : at[i] + size[i]] for i in indexed.tolist()]) + 1
        stops = stops[: len(heads)]
        here = stops - size[heads]
        hit = repeated_windows(FMIndex(text, np.flatnonzero(~inside), len(known) + 1), text, here, stops, window)
        for a, b, group in zip(here.tolist(), stops.tolist(), same.values(), strict=True):
            for i in group:
                found[begins[i] : ends[i]] |= hit[a:b]
    # a window that starts in one segment and ends in the next is none
    edge = np.diff(np.concatenate([[0], found.astype(np.int8)]))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    seg = np.searchsorted(starts + sizes, a, side="right")
    flat = np.stack([a - starts[seg], b - starts[seg]], 1).astype(np.int32).ravel()
    offsets = np.concatenate([[0], 2 * np.cumsum(np.bincount(seg, minlength=len(sizes)))])
    spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
    out = pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in ("v", "s1", "s2")), spans], names=["v",
        "s1", "s2", "spans"])
    return out.filter(pa.array(np.diff(offsets) > 0))


def windows_of(part: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """The windows of segments (v, s1, s2, n, words), one by one: two hashes and the offset."""
    words = part.column("words").to_pylist()
    sizes = np.array([len(x) // 8 for x in words], np.int64)
    s = object.__new__(Segments)
    s.words = np.frombuffer(b"".join(words), np.uint64)
    n = sizes - window + 1
    first, row = np.cumsum(n) - n, np.repeat(np.arange(len(n)), n)
    offset = np.arange(int(n.sum())) - first[row]
    w1, w2 = s.hashes((np.cumsum(sizes) - sizes)[row] + offset, np.full(len(offset), window, np.int64))
    return pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row, pa.int64())) for c in ("v", "s1", "s2",
        "n")), pa.array(w1), pa.array(w2), pa.array(offset, pa.int32())], names=["v", "s1", "s2", "n", "w1", "w2", "a"])


def _alike(s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different pair stands first, and how often it does."""
    _, once, which, n = np.unique(s1, return_index=True, return_inverse=True, return_counts=True)
    if (s2 == s2[once][which]).all():
        return once, n
    pairs = np.stack([s1, s2], 1)
    return np.unique(pairs, axis=0, return_index=True, return_counts=True)[1:]


def _identified(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string")
        .alias("text"))


def passages(docs: DataFrame, window: int = WINDOW, hot: int = HOT, shard_words: int = SHARD_WORDS,
    filter_bits: int = MOST_FILTER_BITS) -> DataFrame:
    """Repeated windows: (doc_id, th, a, b) says that in the text with this doc_id and hash (xxhash64) the windows that start at words a to b - 1 start elsewhere too.

    Spans of a text may touch or be given twice."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = _identified(docs)
    id_type = texts.schema["doc_id"].dataType.simpleString()

    def values(part: pa.RecordBatch):
        s = Segments(utf8(part.column("text")), window)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s.value, s.value[s.own]]).view(np.int64))], names=[
            "v"])

    counted = mapped(texts.select("text"), values, "v long").groupBy("v").agg(F.count("*").alias("n")).where(
        "n >= 2").select("v")
    often = sc.broadcast(_bits(materialize(counted, "repeated-minimizers"), filter_bits))

    def candidates(part: pa.RecordBatch):
        s = Segments(utf8(part.column("text")), window)
        on = np.flatnonzero(_in(often.value, s.value))
        s1, s2 = s.hashes(s.at[on], s.windows[on] + window - 1)
        own = [pa.array(s.value[on].view(np.int64)), pa.array(s1), pa.array(s2), pa.array(s.start[on], pa.int32()),
            pa.array(s.windows[on], pa.int32()), pa.array(s.own[on])]
        yield pa.RecordBatch.from_arrays([_take(part, "doc_id", s.doc[on]), _take(part, "th", s.doc[on]), *own], names=[
            "doc_id", "th", "v", "s1", "s2", "start", "windows", "own"])

    places = mapped(texts, candidates,
        f"doc_id {id_type}, th long, v long, s1 long, s2 long, start int, windows int, own boolean")
    places = materialize(places, "segments")
    distinct = places.groupBy("v", "s1", "s2").agg(F.count("*").alias("n"), F.max("windows").alias("windows"),
        F.bool_or("own").alias("own"))
    kinds = distinct.groupBy("v").agg(F.count("*").alias("kinds"), F.sum("n").alias("n"), F.sum(F.col("windows")
        + window).alias("words"), F.bool_or("own").alias("own"))
    kinds = materialize(kinds.where("n >= 2 or own"), "shared-minimizers")
    size = kinds.where(F.col("kinds") <= hot).agg(F.sum("words").alias("words")).first()["words"] or 0
    shards = max(1, -(-size // shard_words))
    shared = sc.broadcast(_bits(kinds.where(F.col("kinds") <= hot), filter_bits))
    crowded = sc.broadcast(_bits(kinds.where(F.col("kinds") > hot), filter_bits))
    any_crowded = bool(crowded.value.any())

    def words(batches):
        """The segments of a task's texts, each with its words once: how often one comes again is told at the end, without them."""
        names = ["v", "s1", "s2", "n", "words"]
        seen: dict[tuple[int, int], list[int]] = {}  # hashes only
        try:
            for part in (c for batch in batches for c in chunks(batch, "text")):
                s = Segments(utf8(part.column("text")), window)
                on = np.flatnonzero(_in(shared.value, s.value) | _in(crowded.value, s.value))
                size = s.windows[on] + window - 1
                s1, s2 = s.hashes(s.at[on], size)
                once, n = _alike(s1, s2)
                v = s.value[on][once].view(np.int64)
                new = []
                for j, (key, m, own) in enumerate(zip(zip(s1[once].tolist(), s2[once].tolist()), n.tolist(), v.tolist())):
                    if key in seen:
                        seen[key][1] += m
                    else:
                        seen[key] = [own, 0]
                        new.append(j)
                once, n, v = once[new], n[new], v[new]
                data = memoryview(s.words.tobytes())
                own = [bytes(data[8 * a : 8 * (a + n)]) for a, n in zip(s.at[on][once].tolist(), size[once].tolist(),
                    strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(s1[once]), pa.array(s2[once]), pa.array(n, pa.int64()), pa.array(own, pa.binary())], names=names)
            again = [(v, a, b, m) for (a, b), (v, m) in seen.items() if m]
            columns = [pa.array([x[i] for x in again], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(again), pa.binary())], names=names)
        finally:
            release()

    def split(keep_crowded: bool):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(_in(crowded.value, b.column("v").to_numpy().view(np.uint64)) == keep_crowded))

        return run

    def shard(batches):
        parts = [b for b in batches if b.num_rows]
        if parts:
            yield search_shard(parts, window)
        release()

    def single(batches):
        for b in batches:
            if b.num_rows:
                yield windows_of(b, window)

    text_schema = "v long, s1 long, s2 long, n long, words binary"
    spread = max(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # dealt by v at once: what is grouped by v and hashes stays where it is
    segments = texts.select("text").mapInArrow(words, text_schema).repartition(spread, "v").groupBy("v", "s1", "s2").agg(F.sum("n").alias("n"), F.first(
        "words", ignorenulls=True).alias("words"))
    found = segments
    if any_crowded:  # the windows of a minimizer with too many segments become segments of their own
        segments = materialize(segments, "segment-words")
        found = segments.mapInArrow(split(False), text_schema)
        many = materialize(segments.mapInArrow(split(True), text_schema), "crowded-segments")
        lone = materialize(many.mapInArrow(single, "v long, s1 long, s2 long, n long, w1 long, w2 long, a int"),
            "crowded-windows")
        again = lone.groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.min(F.struct("v", "s1", "s2", "a")).alias(
            "at")).where("n >= 2")
        again = again.select("w1", "w2", F.col("n").alias("times"), "at.*").join(many.drop("n"), ["v", "s1", "s2"])
        cut = F.expr(f"substring(words, 8 * a + 1, {8 * window})")
        found = found.unionByName(again.select(F.col("w1").alias("v"), F.col("w1").alias("s1"), F.col("w2").alias("s2"),
            F.col("times").alias("n"), cut.alias("words")))
        found = found.repartition(spread, "v")
    searched = found.mapInArrow(shard, "v long, s1 long, s2 long, spans array<int>")
    if any_crowded:  # back from windows to the segments that they are from
        searched = materialize(searched, "searched-segments")
        ones = searched.where("v = s1").select(F.col("s1").alias("w1"), F.col("s2").alias("w2"))
        of_windows = lone.join(ones, ["w1", "w2"]).select("v", "s1", "s2", F.array("a", F.col("a") + 1).alias("spans"))
        searched = searched.unionByName(of_windows)
    each = F.explode(F.expr("transform(sequence(0, size(spans) - 2, 2), i -> named_struct('a', spans[i], 'b', spans[i "
        "+ 1]))"))
    return places.join(searched, ["v", "s1", "s2"]).select("doc_id", "th", "start", each.alias("s")).select("doc_id",
        "th", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))


def stripped_rows(docs: DataFrame, window: int = WINDOW, with_text: bool = True, **options) -> DataFrame:
    """Per row: row (a struct of all columns of docs but text), text (as it was; if wanted), n_words, n_removed, kept (the words that no repeated window covers,
    joined by one space)."""
    spans = passages(docs, window, **options).groupBy("doc_id", "th").agg(F.collect_set(F.struct("a", "b")).alias(
        "spans"))  # at most two for each word of a text
    spans = spans.select(F.col("doc_id").alias("of"), F.col("th").alias("of_th"), "spans")
    rows = docs.select(F.struct(*[quoted(c) for c in docs.columns if c != "text"]).alias("row"), F.col("text")
        .cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    rows = rows.join(spans, F.col("row.doc_id").eqNullSafe(spans["of"]) & (rows["th"] == spans["of_th"]),
        "left").select("row", "text", "spans")
    kept_as_is = ["row", "text"] if with_text else ["row"]
    schema = T.StructType([*(rows.schema[c] for c in kept_as_is), T.StructField("n_words", T.LongType()), T.StructField(
        "n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def work(part: pa.RecordBatch):
        n_words, n_removed, kept = [], [], []
        for text, own in zip(utf8(part.column("text")), part.column("spans"), strict=True):
            words = text.split()
            n_words.append(len(words))
            if not own.is_valid:
                n_removed.append(0)
                kept.append(b" ".join(words).decode())
                continue
            edge = np.zeros(len(words) + 1, np.int64)
            flat = own.values
            np.add.at(edge, flat.field("a").to_numpy(), 1)
            np.add.at(edge, np.minimum(flat.field("b").to_numpy() + window - 1, len(words)), -1)
            free = np.cumsum(edge)[:-1] == 0
            left = [w for w, f in zip(words, free.tolist(), strict=True) if f]
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left).decode())
        results = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([*map(part.column, kept_as_is), *results], names=[*kept_as_is, "n_words",
            "n_removed", "kept"])

    return mapped(rows, work, schema)


def strip(docs: DataFrame, window: int = WINDOW, keep: bool = False, **options) -> DataFrame:
    """Per row: doc_id (with keep: all columns but text), n_words, n_removed, kept.  A column of docs that is named like a result gives way to it."""
    names = ("n_words", "n_removed", "kept")
    others = [c for c in docs.columns if c not in names and c != "text"] if keep else ["doc_id"]
    used = docs if keep else docs.select("doc_id", "text")
    return stripped_rows(used, window, False, **options).select(*[F.col(f"row.`{c}`") for c in others], *names)
