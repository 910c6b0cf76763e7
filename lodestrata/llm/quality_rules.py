"""Quality rules by weak supervision.

Each rule looks at a whole text and votes good (+1), bad (-1) or abstains (0).  Nobody says which rules
are right: expectation-maximisation over the votes of all documents estimates how often each rule votes what for good
and for bad documents, and a document's verdict is its posterior probability of being good.  A document
votes in one of 3**8 patterns at most, so all that the estimate needs from the corpus is a count per pattern: one
aggregation with map-side combine, whatever the corpus's size.

Defined cases: a null text counts as empty; an empty text has no words and fails the base rules; equal rows get
equal rows; an empty table gives an empty result; further columns of the input are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, materialize, numbered_words, packed, unpacked, utf8

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
#: Bytes of letters: ASCII ones and every byte of a character beyond ASCII.
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(w.encode() for w in "the and of to in is that for it on with as are be this by der die das "
    "und zu den von mit für im ist des le la les de et des un une que pour dans est el los las que en y por con una "
    "para".split())  # fmt: skip

RULES = ("symbols", "dup_lines", "repeats", "capitals", "shouting", "word_length", "function_words", "endings")
FEATURES = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines",
    pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("pattern", pa.int32())])
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, pattern int"


def repeated(ids: np.ndarray, starts: np.ndarray, n_ids: int, width: int = 3) -> np.ndarray:
    """For each word, whether a window of width words around it is found twice or more in its text.  Exact: windows get numbers, not hashes."""
    n = len(ids)
    covered = np.zeros(n, bool)
    if n < width:
        return covered
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    key = ids
    for k in range(1, width):
        key = key[:-1] * n_ids + ids[k:]
        if k + 1 < width and n_ids ** (k + 2) >= 2**63:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
    inside = doc[: n - width + 1] == doc[width - 1 :]
    at = np.flatnonzero(inside)
    key, own = key[at], doc[at]
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(width):
        covered[at[twice] + k] = True
    return covered


def features(texts: list[bytes]) -> pa.RecordBatch:
    """The counts of each text and the pattern of its votes."""
    ids, starts, numbers = numbered_words(texts)
    n_words = np.diff(starts)
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[starts])
    repeats = total(repeated(ids, starts, max(1, len(numbers))))
    known = np.fromiter((w.lower().rstrip(b".,!") in FUNCTION_WORDS for w in numbers), bool, len(numbers))
    functions = total(known[ids]) if len(ids) else np.zeros(len(texts), np.int64)
    rows = []
    for t in texts:
        body = t.translate(None, SPACES)
        letters = len(body) - len(body.translate(None, LETTERS))
        upper = len(body) - len(body.translate(None, UPPER))
        symbols = len(body) - len(body.translate(None, SYMBOLS))
        lines = [x for line in t.split(b"\n") if (x := line.strip())]
        dup = len(full := [line for line in t.split(b"\n") if line.strip()]) - len(set(full))
        ended = sum(line.endswith((b".", b"!", b"?", b":", b'"')) for line in lines)
        chars = len(body) if body.isascii() else len(body.decode())
        rows.append((chars, symbols, dup, letters, upper, body.count(b"!"), len(lines), ended))
    chars, symbols, dup, letters, upper, cries, lines, ended = np.array(rows, np.int64).reshape(-1, 8).T
    words = np.maximum(n_words, 1)
    vote = lambda good, bad: np.where(bad, -1, np.where(good, 1, 0))
    mean = chars / words
    votes = [
        vote(symbols <= 0.02 * words, symbols > 0.1 * words),
        vote((dup == 0) & (lines >= 4), dup > 0.2 * np.maximum(lines, 1)),
        vote(repeats <= 0.1 * words, repeats > 0.3 * words),
        vote(upper <= 0.12 * np.maximum(letters, 1), upper > 0.25 * np.maximum(letters, 1)),
        vote(np.zeros(len(words), bool), cries > 0.1 * words),
        vote((mean >= 3) & (mean <= 9), (mean < 2) | (mean > 14)),
        vote(functions >= 0.15 * words, functions < 0.02 * words),
        vote((ended >= 0.6 * lines) & (lines > 0), ended < 0.1 * lines),
    ]
    pattern = np.zeros(len(texts), np.int32)
    for v in votes:
        pattern = pattern * 3 + (v + 1).astype(np.int32)
    failed = (n_words < 50) | (100 * repeats > 50 * n_words)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((n_words, chars, symbols, dup, repeats,
        failed, pattern), FEATURES, strict=True)], schema=FEATURES)


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and the features of each row."""

    def work(part: pa.RecordBatch):
        got = features(utf8(part.column("text")))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *got.columns], names=["doc_id", *got.schema.names])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return mapped(docs, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def unpack(patterns: np.ndarray) -> np.ndarray:
    """Votes (-1, 0, 1) of each pattern, a column a rule."""
    return np.stack([patterns // 3 ** (len(RULES) - 1 - j) % 3 - 1 for j in range(len(RULES))], 1)


def fit(counts: dict[int, int], rounds: int = 200) -> dict:
    """Expectation-maximisation over pattern counts.

    Returns the share of good documents, each rule's probabilities of voting -1, 0 or 1 for bad and for good documents, and
    the posterior of each pattern.  It starts from majority votes, and nine pseudo-documents a rule and class that vote
    rightly rather than wrongly keep the two classes from changing places."""
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    if not len(patterns):
        return {"good": 0.5, "tables": np.full((2, len(RULES), 3), 1 / 3), "posterior": {}}
    votes = unpack(patterns)
    belief = np.where(votes.min(1) < 0, 0.25, 0.9)
    belief = np.clip(0.5 * belief + 0.5 * (votes.mean(1) + 1) / 2, 0.02, 0.98)
    prior = np.array([[3.0, 5.0, 1.0], [1.0, 5.0, 3.0]])
    good, tables = 0.5, None
    for _ in range(rounds):
        tables = np.empty((2, len(RULES), 3))
        for y, b in enumerate((1 - belief, belief)):
            for v in (-1, 0, 1):
                tables[y, :, v + 1] = ((n * b)[:, None] * (votes == v)).sum(0) + prior[y, v + 1]
        tables /= tables.sum(2, keepdims=True)
        good = ((n * belief).sum() + 1) / (n.sum() + 2)
        pick = np.arange(len(RULES))
        log = [np.log(tables[y, pick, votes + 1]).sum(1) + np.log(g) for y, g in enumerate((1 - good, good))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        done, belief = np.abs(new - belief).max() < 1e-9, new
        if done:
            break
    return {"good": float(good), "tables": tables, "posterior": dict(zip(patterns.tolist(), belief.tolist(),
        strict=True))}


def pattern_counts(scored: DataFrame) -> dict[int, int]:
    """At most 3**8 rows come to the driver."""
    return {r["pattern"]: r["n"] for r in scored.groupBy("pattern").agg(F.count("*").alias("n")).collect()}


def score(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, the counts, base_failed, the posterior and kept.  One pass over the texts; the counts are kept in a table meanwhile."""
    scored = materialize(with_features(docs), "quality-rules")
    model = fit(pattern_counts(scored))
    posterior = docs.sparkSession.createDataFrame(list(model["posterior"].items()), "pattern int, posterior double")
    return scored.join(F.broadcast(posterior), "pattern", "left").select("doc_id", "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("posterior") >= threshold))
        .alias("kept"), "posterior")


def keep(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score() keeps, as they are.  Texts are read twice rather than shuffled once."""
    good = frozenset(p for p, x in fit(pattern_counts(with_features(docs)))["posterior"].items() if x >= threshold)

    def work(part: pa.RecordBatch):
        got = features(utf8(part.column("text")))
        failed, pattern = got.column("base_failed").to_pylist(), got.column("pattern").to_pylist()
        yield part.filter(pa.array([not f and p in good for f, p in zip(failed, pattern, strict=True)], pa.bool_()))

    rows = packed(docs)
    return unpacked(mapped(rows, work, rows.schema), docs.columns)
