"""Secret scans by a battery of randomness tests.

Base rules find assignments, access keys and hexadecimal runs.  Beyond them, every run of 16 or more characters that keys are written in is a
candidate: its encoding is the smallest alphabet that holds all of it, and its characters become values of that alphabet.  The battery asks whether
these are drawn at random:

* chi-squared of the counts against a uniform alphabet, with the exact mean and variance that it has at this length,
* the number of runs of values in the lower and the upper half of the alphabet,
* the correlation of each value with the next one,

and Fisher's method combines the three.  A candidate that the battery rejects is no secret.  One that it doesn't reject may be too short to tell:
so the same chi-squared is also held against what the corpus's own characters outside of candidates, limited to the same alphabet and drawn as often
as the candidate is long, would give.  The probability that these look as uniform falls with length, and the Benjamini-Hochberg rule over
all candidates of all documents says which are few enough to be believed.  Short candidates thus need to be far more uniform than long ones, and
how many false ones are among those reported is bounded, whatever mixture of lengths the corpus holds.

Each text is scanned once, whole; what is found (places and three numbers a candidate) is written as a table, over which character
counts and the rule's histogram are summed.  The histogram has a fixed number of bins on the logarithm of the probability, and a bin is taken whole or
not at all, which can only keep more out.

Defined cases: a null or empty text has no spans; equal texts have equal spans; without candidates, or without any characters outside of them, nothing is added;
an empty table gives an empty result; further columns are not looked at.  Memory is a few times a text's size.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialize, utf8

#: Kinds of spans in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN = re.compile(rb"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX, LEAST = 12, 18, 16, 16
#: Below this combined probability the battery rejects randomness; the share of false ones among those reported; bins a decade, and decades.
REJECT, RATE, BINS, DECADES = 0.001, 0.01, 8, 40

_DIGITS, _LOWER, _UPPER = b"0123456789", bytes(range(97, 123)), bytes(range(65, 91))
#: Alphabets by name, from small to large: a text's encoding is the first that holds all its characters.
ALPHABETS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + b"abcdef",
    "hex_upper": _DIGITS + b"ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + b"234567",
    "base36": _DIGITS + _LOWER,
    "base36_upper": _DIGITS + _UPPER,
    "letters": _UPPER + _LOWER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + b"+/",
    "base64_url": _UPPER + _LOWER + _DIGITS + b"-_",
}
ENCODINGS = list(ALPHABETS)


def _mask(letters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(letters, np.uint8)] = True
    return out


_WORD = _mask(_DIGITS + _UPPER + _LOWER)
_CANDIDATE = _mask(_DIGITS + _UPPER + _LOWER + b"+/-_")
_HEX = _mask(_DIGITS + b"abcdef")
_LEAD = ~_mask(bytes(range(0x80, 0xC0)))
#: Of each byte the alphabets that hold it, a bit each; and its value in each alphabet.
_MEMBER = np.zeros(256, np.uint16)
_VALUE = np.zeros((len(ENCODINGS), 256), np.int64)
for _e, _letters in enumerate(ALPHABETS.values()):
    _own = np.frombuffer(_letters, np.uint8)
    _MEMBER[_own] |= np.uint16(1 << _e)
    _VALUE[_e, _own] = np.arange(len(_own))


def runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Where mask holds least times or more in a row."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    long = end - begin >= least
    return list(zip(begin[long].tolist(), end[long].tolist()))


def encoding(own: np.ndarray) -> int | None:
    """The number of the smallest alphabet that holds all these bytes."""
    held = int(np.bitwise_and.reduce(_MEMBER[own]))
    return (held & -held).bit_length() - 1 if held else None


def candidates(data: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Begin, end and encoding of each run to test.  What no alphabet holds is taken apart at what is no letter or digit."""
    for a, b in runs(_CANDIDATE[data], LEAST):
        e = encoding(data[a:b])
        if e is not None:
            yield a, b, e
            continue
        for c, d in runs(_WORD[data[a:b]], LEAST):
            yield a + c, a + d, encoding(data[a + c : a + d])


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity(values: np.ndarray, size: int) -> float:
    """Pearson's chi-squared of values against a uniform alphabet of this size."""
    counts = np.bincount(values, minlength=size)
    return float((counts.astype(float) ** 2).sum() * size / len(values) - len(values))


def battery(values: np.ndarray, size: int) -> tuple[float, float]:
    """Chi-squared, and the combined probability that random values look as little random as these."""
    n = len(values)
    x2 = uniformity(values, size)
    # chi-squared's mean is size - 1 and its variance 2 (size - 1) (n - 1) / n: a scaled gamma of these, by Wilson and Hilferty's cube root
    freedom = (size - 1) * n / (n - 1)
    cube = (x2 / (size - 1)) ** (1 / 3)
    spread = math.sqrt(2 / (9 * freedom))
    chi = min(1.0, 2 * normal_tail(abs((cube - 1 + spread * spread) / spread)))
    low = values * 2 < size
    n1 = int(low.sum())
    n2 = n - n1
    if n1 and n2:
        turns = 1 + int((low[1:] != low[:-1]).sum())
        mean = 1 + 2 * n1 * n2 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        run = 2 * normal_tail(max(0.0, abs(turns - mean) - 0.5) / math.sqrt(var)) if var > 0 else 1.0
    else:
        run = 2.0 ** (1 - n)
    centred = values - values.mean()
    total = float((centred * centred).sum())
    if total > 0:
        r = float((centred[1:] * centred[:-1]).sum()) / total
        serial = 2 * normal_tail(abs(r + 1 / n) * math.sqrt(n))
    else:
        serial = 0.0
    half = -sum(math.log(max(min(p, 1.0), 1e-300)) for p in (chi, run, serial))
    return x2, math.exp(-half) * (1 + half + half * half / 2)


def natural(size: int, n: int, x2: float, shares: np.ndarray) -> float:
    """The probability that n characters drawn with these shares give so small a chi-squared: the mean and variance of the sum of squared
    counts are exact, its distribution is taken as a gamma by the cube root."""
    s2, s3 = float((shares**2).sum()), float((shares**3).sum())
    pairs = n * (n - 1)
    mean = n + pairs * s2
    # variance of the sum of c (c - 1) over cells, from factorial moments of the multinomial
    var = pairs * (2 * s2 + 4 * (n - 2) * s3 + (6 - 4 * n) * s2 * s2)
    found = (x2 + n) * n / size
    if var <= 0:
        return 1.0
    # shifted by the least possible value n, so that the gamma starts where the sum does
    shape = (mean - n) ** 2 / var
    spread = math.sqrt(1 / (9 * shape))
    cube = (max(found - n, 0.0) / (mean - n)) ** (1 / 3)
    return normal_tail(-(cube - 1 + spread * spread) / spread)


def base_spans(text: bytes, data: np.ndarray) -> list[tuple[int, int, int]]:
    """Begin, end and kind of the base rules' spans, in bytes."""
    out = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(a, b, 2) for a, b in runs(_HEX[data], LEAST_HEX)]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, spans (kind, start, finish) of the base rules, tests (start, finish, encoding, length, chi-squared, combined
    probability) of the candidates, and in some rows letters: how often each ASCII character stands outside of candidates in several of them."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("finish", pa.int64())])
    test = pa.struct([("start", pa.int64()), ("finish", pa.int64()), ("encoding", pa.int32()), ("length", pa.int64()), ("x2", pa.float64()), ("random", pa.float64())])

    def work(part: pa.RecordBatch):
        spans, tests, letters = [], [], np.zeros(128, np.int64)
        for t in utf8(part.column("text")):
            data = np.frombuffer(t, np.uint8)
            letters += np.bincount(data, minlength=256)[:128]
            found, tested = base_spans(t, data), []
            for a, b, e in candidates(data):
                letters -= np.bincount(data[a:b], minlength=128)
                x2, p = battery(_VALUE[e, data[a:b]], len(ALPHABETS[ENCODINGS[e]]))
                tested.append((a, b, e, b - a, x2, p))
            if not t.isascii() and (found or tested):  # places in characters
                at = np.concatenate([[0], np.cumsum(_LEAD[data])])
                found = [(int(at[a]), int(at[b]), k) for a, b, k in found]
                tested = [(int(at[a]), int(at[b]), *rest) for a, b, *rest in tested]
            spans.append([{"kind": k, "start": a, "finish": b} for a, b, k in sorted(found, key=lambda s: (s[0], s[2], s[1]))])
            tests.append([dict(zip(("start", "finish", "encoding", "length", "x2", "random"), x)) for x in tested])
        counts = [letters.tolist()] + [None] * (part.num_rows - 1)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, pa.list_(span)), pa.array(tests, pa.list_(test)), pa.array(counts,
            pa.list_(pa.int64()))], names=["doc_id", "spans", "tests", "letters"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, work, f"doc_id {kind}, spans array<struct<kind int, start long, finish long>>, tests array<struct<start long, finish long, "
        "encoding int, length long, x2 double, random double>>, letters array<long>")


def shares(scanned: DataFrame) -> dict[int, np.ndarray]:
    """For each encoding with characters outside of candidates, the share of each value among them."""
    totals = np.zeros(128, np.int64)
    for r in scanned.where("letters is not null").select(F.posexplode("letters")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        totals[r["pos"]] = r["n"]  # 128 rows at most
    found = {}
    for e, letters in enumerate(ALPHABETS.values()):
        own = totals[np.frombuffer(letters, np.uint8)].astype(float)
        if own.sum() > 0:
            found[e] = own / own.sum()
    return found


def decade(size: int, n: int, x2: float, p: float, own: np.ndarray | None) -> int:
    """The bin of a candidate: that of its probability among the corpus's characters, 0 if it is near 1 or the battery rejects it."""
    if own is None or p < REJECT:
        return 0
    return min(int(-math.log10(max(natural(size, n, x2, own), 1e-300)) * BINS), BINS * DECADES)


def believed(scanned: DataFrame, known: dict[int, np.ndarray]) -> DataFrame:
    """Rows of scanned with bins: the bin of each test."""
    sizes = [len(a) for a in ALPHABETS.values()]

    def work(part: pa.RecordBatch):
        bins = [[decade(sizes[x["encoding"]], x["length"], x["x2"], x["random"], known.get(x["encoding"])) for x in own or ()] for own in
            part.column("tests").to_pylist()]
        columns = [part.column(c) for c in ("doc_id", "spans", "tests")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(bins, pa.list_(pa.int32()))], names=["doc_id", "spans", "tests", "bins"])

    def run(batches):
        for batch in batches:
            yield from work(batch)

    kinds = {f.name: f.dataType.simpleString() for f in scanned.schema}
    return scanned.select("doc_id", "spans", "tests").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "spans", "tests"))
        + ", bins array<int>")


def threshold(binned: DataFrame, rate: float = RATE) -> int | None:
    """The lowest bin that Benjamini and Hochberg's rule reports: all candidates count, each at its bin's largest probability."""
    counts = {r["b"]: r["n"] for r in binned.select(F.explode("bins").alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()}
    total, above, lowest = sum(counts.values()), 0, None
    for b in sorted(counts, reverse=True):  # a bounded number of bins
        above += counts[b]
        if b > 0 and 10 ** (-b / BINS) <= rate * above / total:
            lowest = b
    return lowest


def secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per row: doc_id and spans (kind, start, finish), those of the base rules and, of kind random, those that the battery adds.

    A candidate that overlaps a span of a base rule adds nothing."""
    scanned = materialize(scan(docs), "secret-scan")
    binned = believed(scanned, shares(scanned))
    lowest = threshold(binned, rate)
    if lowest is None:
        return scanned.select("doc_id", "spans")

    def run(batches):
        for batch in batches:
            out = []
            for spans, tests, bins in zip(*(batch.column(c).to_pylist() for c in ("spans", "tests", "bins"))):
                spans = spans or []
                taken = sorted((s["start"], s["finish"]) for s in spans)
                ends = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
                begins = [a for a, _ in taken]
                new = []
                for x, b in zip(tests or (), bins or ()):
                    at = int(np.searchsorted(begins, x["finish"]))  # base spans that begin before this one ends
                    if b >= lowest and not (at and ends[at - 1] > x["start"]):
                        new.append({"kind": 3, "start": x["start"], "finish": x["finish"]})
                out.append(sorted(spans + new, key=lambda s: (s["start"], s["kind"], s["finish"])) if new else spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, batch.column("spans").type)], names=["doc_id", "spans"])

    kind = binned.schema["doc_id"].dataType.simpleString()
    return binned.mapInArrow(run, f"doc_id {kind}, spans {binned.schema['spans'].dataType.simpleString()}")


def written(spans: str, only_base: bool = False):
    """Spans as kind:start:finish, joined by commas."""
    own = F.filter(spans, lambda s: s["kind"] < 3) if only_base else F.col(spans)
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["finish"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of spans of each base rule, a hash of them, and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])], F.sha2(written("spans", True),
        256).alias("base_sha256"), written("spans").alias("spans"))
