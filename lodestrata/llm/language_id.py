"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text knows every substring of it.  A text is parsed from left to right into
the longest phrases found there; the language whose text needs the fewest phrases, each at the price of a
position in the training text, wins.

The automaton becomes a table: state and letter give the next state, and a flag where the phrase ends and the next begins with
that letter.  So all texts of a batch walk through the tables in step, a few numpy operations a letter whatever the number of texts.
Long texts walk in lanes of LANE letters: each lane first as if a phrase began with it, then again from the state in which the lane before
it really ended, until both walks are in the same state, after which they stay together.  So the parse is that of the whole text.

Training is bounded by rows: of each language the `rows` whole texts of lowest hash among those of `longest` characters or less (its shortest text,
if it has none).  These two parameters are set by held-out accuracy; no text is cut.  Letters are
lower-cased, runs of anything else become one space, and letters beyond the ALPHABET most frequent share a class.

Defined cases: a null text or one without letters is `und` with score 0; without any labelled text every text is `und`; on
equal phrase counts the language that comes first in the alphabet wins; equal texts get equal answers; an empty
table gives an empty result; rows whose id or language is null are not learnt from; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, mapped

ALPHABET, LANE = 60, 512
#: Labelled texts a language to learn from, and characters of the longest of these.
ROWS, LONGEST = 32, 1500
#: Letters of text from which the score's evidence is counted.
EVIDENCE = 50


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the root."""
    nxt, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def parse_table(codes: list[int], width: int) -> np.ndarray:
    """The walk of the cross-parsing: entry [state * width + c] is 2 * (next state * width) + (1 if a phrase ended before c).

    A letter that the training text lacks is a phrase by itself."""
    nxt = suffix_automaton(codes)
    spent = len(nxt)  # the state after a letter that the training text lacks: whatever follows starts a phrase
    table = np.empty((spent + 1, width), np.int32)
    root = np.full(width, 2 * spent * width + 1, np.int32)
    for c, s in nxt[0].items():
        root[c] = 2 * s * width + 1
    table[:] = root
    for s, own in enumerate(nxt):
        for c, t in own.items():
            table[s, c] = 2 * t * width
    table[0] &= ~1  # only a window's first letter is read at the root
    return table.ravel()


class Alphabet:
    """Code points to codes: 0 for what is no letter, 1.. for letters, then one for other letters."""

    def __init__(self, letters: str):
        self.letters = letters
        self.other, self.width = len(letters) + 1, len(letters) + 2
        self.codes = np.zeros(0x110000, np.uint8)
        number = {c: i + 1 for i, c in enumerate(letters)}
        for cp in range(0x110000):
            ch = chr(cp)
            if ch.isalpha():
                self.codes[cp] = number.get(ch.lower()[:1], self.other)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts, runs of non-letters as one 0, and where each text starts (one more at the end)."""
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        raw = self.codes[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)]
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != 0) | (raw[:-1] != 0)
        ends = np.cumsum(lengths)
        starts = np.concatenate([[0], np.cumsum(keep)[ends - 1]]).astype(np.int64) if len(ends) else np.zeros(1,
            np.int64)
        return raw[keep], starts


_alphabets: dict[str, Alphabet] = {}


def alphabet(letters: str) -> Alphabet:
    if letters not in _alphabets:
        _alphabets.clear()
        _alphabets[letters] = Alphabet(letters)
    return _alphabets[letters]


def sample(docs: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> dict[str, list[str]]:
    """rows labelled texts a language at most, those of lowest hash among the ones of up to longest characters, none of them held out.  Bounded by rows,
    longest and languages."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (F.length("text") > 0))
    short = F.length("text") <= longest
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count_if(short).alias("n")).collect()}
    if not counts:
        return {}
    span = 1 << 30
    limits = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, 2 * rows / n) * span) if n else 0)])
    h = F.pmod(F.xxhash64("doc_id"), F.lit(span))
    near = known.where(short & (h < limits[F.col("lang")])).select("lang", h.alias("h"), "text")
    first = Window.partitionBy("lang").orderBy("h", "text")
    found = near.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= rows).select("lang", "text", "nth").collect()
    without = [lang for lang, n in counts.items() if not n]
    if without:  # one text each
        found += known.where(F.col("lang").isin(without)).groupBy("lang").agg(F.min_by("text", F.struct(F.length("text"), h, "text")).alias("text"), F.lit(
            1).alias("nth")).collect()
    out: dict[str, list[str]] = {lang: [] for lang in sorted(counts)}
    for r in sorted(found, key=lambda r: (r["lang"], r["nth"])):
        out[r["lang"]].append(r["text"])
    return {k: v for k, v in out.items() if v}


def fit(texts: dict[str, list[str]]) -> dict:
    """Tables per language from labelled texts."""
    joined = {lang: " ".join(own).lower() for lang, own in texts.items()}
    seen = Counter(c for t in joined.values() for c in t if c.isalpha())
    letters = "".join(c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET])
    a = alphabet(letters)
    tables, sizes = [], []
    for lang in sorted(joined):
        codes = a.encode([joined[lang]])[0]
        sizes.append(max(2, len(codes)))
        tables.append(parse_table(codes.tolist(), a.width))
    return {"langs": sorted(joined), "letters": letters, "tables": tables, "sizes": sizes}


def phrases(codes: np.ndarray, starts: np.ndarray, table: np.ndarray, width: int, lane: int = LANE) -> np.ndarray:
    """Phrases of each text's parse."""
    n = np.diff(starts)
    lanes = -(-n // lane)
    doc = np.repeat(np.arange(len(n)), lanes)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = starts[doc] + nth * lane
    size = np.minimum(starts[doc + 1] - at, lane)
    after, begins = np.empty(len(codes), np.int32), np.empty(len(codes),
        np.uint8)  # the state after each letter; whether a phrase begins with it

    def walk(which: np.ndarray, state: np.ndarray, again: bool) -> np.ndarray:
        """Walks lanes from a state each; again: until it is in the recorded state.  Returns the lanes that ended in another state than recorded."""
        order = np.argsort(-size[which], kind="stable")
        which, state = which[order], state[order]
        place, left = at[which], size[which]
        while len(which):
            got = table[state + codes[place]]
            state = got >> 1
            begins[place] = got & 1
            going = left > 1
            if again:
                apart = after[place] != state
                ended = which[apart & ~going]
                if len(ended):
                    unlike.append(ended)
                going &= apart
            after[place] = state
            if going.all():
                place, left = place + 1, left - 1
            else:
                which, state, place, left = which[going], state[going], place[going] + 1, left[going] - 1
        return np.concatenate(unlike) if unlike else which[:0]

    unlike: list[np.ndarray] = []
    walk(np.arange(len(doc)), np.zeros(len(doc), np.int32), False)
    todo = np.flatnonzero(nth > 0)
    while len(todo):
        unlike = []
        todo = walk(todo, after[at[todo] - 1], True) + 1
        todo = todo[todo < len(doc)]
        todo = todo[nth[todo] > 0]  # the lanes behind those whose end has changed
    sums = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    return sums[starts[1:]] - sums[starts[:-1]] + (n > 0)


def predict(texts: list[str], model: dict) -> tuple[list[str], np.ndarray]:
    langs = model["langs"]
    if not langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    a = alphabet(model["letters"])
    codes, starts = a.encode(texts)
    n = np.diff(starts)
    letters = np.diff(np.concatenate([[0], np.cumsum(codes != 0)])[starts])
    price = np.array([math.log2(s) for s in model["sizes"]])
    used = np.stack([phrases(codes, starts, t, a.width) for t in model["tables"]], 1)
    bits = used * price / np.maximum(n, 1)[:, None]  # normalised: bits a letter
    best = bits.argmin(1)
    spread = (bits - bits.min(1, keepdims=True)) * np.minimum(np.maximum(n, 1), EVIDENCE)[:, None]
    share = 1 / np.exp2(-np.minimum(spread, 1000)).sum(1)
    return [langs[b] if k else "und" for b, k in zip(best, letters, strict=True)], np.where(letters > 0, share, 0.0)


def identify(docs: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (the winner's share of the evidence, 0 to 1)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    shared = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, rows, longest)))  # some MB: bounded by languages, rows and longest

    def work(part: pa.RecordBatch):
        lang, score = predict([x or "" for x in part.column("text").to_pylist()], shared.value)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score,
            pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = mapped(docs.select("doc_id", "text"), work,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
