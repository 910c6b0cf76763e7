"""Fill-in-middle transformation by overlapping chunks.

A text's units are its runs of ASCII letters and its other characters, one each.  A unit starts at a character exactly if the character
and the one before it are not both letters, so two adjacent characters decide.  Texts are laid out in chunks that overlap by the
character before them; each chunk counts the starts in it by itself, without looking at the others.  Prefix sums over these counts give every
text's number of units, and route the two ranks at which a text is cut to the chunks that own them: only those are scanned again, for the places.

Where a text is cut, and the form it takes, are hashes of the seed and doc_id: nothing else decides, so any split of the table gives the same rows.

Defined cases: a null or empty text is plain and its output empty; a text that holds one of the marks is plain, so that every output
can be undone; a null doc_id is hashed as an empty one; equal rows give equal rows; an empty table gives an empty result; further columns are not
looked at.  Memory is a few times a text's size, and counts are a few bytes a chunk: the starts themselves are never kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, utf8

#: Bytes in a chunk, and bytes whose starts are looked for together.
CHUNK, BLOCK = 4096, 1 << 22
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Bytes that begin a character in UTF-8.
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def starts(data: np.ndarray, begin: int, end: int, first: np.ndarray) -> np.ndarray:
    """Whether a unit starts at each byte of data[begin:end]; first: the (sorted) places where texts begin, each a start."""
    letter = _LETTER[data[max(begin - 1, 0) : end]]
    own = letter if begin == 0 else letter[1:]
    before = np.concatenate([[False], letter[:-1]]) if begin == 0 else letter[:-1]
    out = _LEAD[data[begin:end]] & ~(own & before)
    lo, hi = np.searchsorted(first, [begin, end])
    out[first[lo:hi] - begin] = True
    return out


class Layout:
    """Texts laid end to end, and the number of unit starts in each of their chunks."""

    def __init__(self, texts: list[bytes], chunk: int = CHUNK, block: int = BLOCK):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.begins = self.at[:-1][sizes > 0]
        pieces = -(-sizes // chunk)
        #: Of each text its first chunk (one more at the end); where each chunk begins (one more at the end).
        self.of = np.concatenate([[0], np.cumsum(pieces)]).astype(np.int64)
        inner = np.arange(self.of[-1]) - np.repeat(self.of[:-1], pieces)
        self.chunks = np.concatenate([np.repeat(self.at[:-1], pieces) + inner * chunk, self.at[-1:]]).astype(np.int64)
        counts = np.zeros(len(self.chunks) - 1, np.int64)
        lo = 0
        while lo < len(counts):  # as many whole chunks as fit in a block, one at least
            hi = max(int(np.searchsorted(self.chunks, self.chunks[lo] + block, "right")) - 1, lo + 1)
            begin = int(self.chunks[lo])
            counts[lo:hi] = np.add.reduceat(starts(self.data, begin, int(self.chunks[hi]), self.begins).view(np.uint8), self.chunks[lo:hi]
                - begin, dtype=np.int64)
            lo = hi
        #: Starts before each chunk, over all texts.
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)

    def units(self) -> np.ndarray:
        """The number of units of each text."""
        return self.before[self.of[1:]] - self.before[self.of[:-1]]

    def place(self, text: int, rank: int) -> int:
        """How many bytes of a text its first `rank` units take: the owning chunk alone is scanned."""
        sought = int(self.before[self.of[text]]) + rank
        if sought == self.before[self.of[text + 1]]:
            return int(self.at[text + 1] - self.at[text])
        owner = int(np.searchsorted(self.before, sought, "right")) - 1
        begin, end = int(self.chunks[owner]), int(self.chunks[owner + 1])
        found = np.flatnonzero(starts(self.data, begin, end, self.begins))
        return begin + int(found[sought - int(self.before[owner])]) - int(self.at[text])


def numbers(seed: int, doc_id: str | None) -> list[int]:
    """Four numbers of a document: the first groups of eight digits of a hash."""
    digits = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """Per row: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output.

    rate: how many of 100 texts are transformed; spm: how many of 100 of these have their suffix first."""
    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").cast("string").alias("text"))

    def work(part: pa.RecordBatch):
        texts = utf8(part.column("text"))
        layout = Layout(texts)
        units = layout.units().tolist()
        forms, heads, middles, outputs = [], [], [], []
        for i, (t, n, key) in enumerate(zip(texts, units, part.column("key").to_pylist())):
            h1, h2, h3, h4 = numbers(seed, key)
            if not t or h3 % 100 >= rate or any(m in t for m in MARKS):
                forms.append("plain")
                heads.append(None)
                middles.append(None)
                outputs.append(t)
                continue
            a, b = (layout.place(i, r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
            prefix, middle, suffix = t[:a], t[a:b], t[b:]
            heads.append(prefix)
            middles.append(middle)
            p, s, m = MARKS
            if h4 % 100 < spm:
                forms.append("spm")
                outputs.append(b"".join((s, suffix, p, prefix, m, middle)))
            else:
                forms.append("psm")
                outputs.append(b"".join((p, prefix, s, suffix, m, middle)))
        string = lambda x: pa.array(x, pa.binary()).cast(pa.string())
        chars = lambda x: pc.utf8_length(string(x)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(units, pa.int64()), pa.array(forms, pa.string()), chars(heads),
            chars(middles), string(outputs)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, work, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of an output: its parts stand between marks that occur once each."""
    size = len(PREFIX)
    first_end = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    rest = F.substr(output, F.lit(size + 1))
    first = F.when(form == "spm", F.substring_index(rest, PREFIX, 1)).otherwise(F.substring_index(rest, SUFFIX, 1))
    rest = F.substr(rest, F.length(first) + F.length(first_end) + 1)
    second = F.substring_index(rest, MIDDLE, 1)
    middle = F.substr(rest, F.length(second) + size + 1)
    return F.when(form == "plain", output).when(form == "spm", F.concat(second, middle, first)).otherwise(F.concat(first, middle, second))
