"""Quality classifier by compression.

A zstandard dictionary is built from good labelled texts and another from bad ones.  A text is compressed, piece by piece,
with either; the difference of the two sizes over the text's size says which kind it is more like, and a logistic curve
fitted to labelled texts that the dictionaries have not seen turns it, with the smaller size over the text's (how much of a text
neither dictionary knows), into the probability of label 1.  Nothing but these two sizes goes into a score.

Pieces of PIECE bytes keep the dictionary in play along the whole of a long text, which would otherwise soon be
compressed by its own past.  The model is fitted on a bounded sample: at most `rows` labelled texts a class, those of lowest hash among the ones of
`longest` bytes or less (where a class has none: its shortest ones), one text an id; half of them go into the dictionary and half into the calibration.  No
text is cut.

Defined cases: a null or empty text has difference 0 and gets the curve's value there; without labels of both classes
every score is the share of label 1 (0.5 without labels); equal texts get equal scores; an empty table gives an
empty result; rows whose id or label is null are not learnt from; further columns are not looked at.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, mapped, utf8

PIECE, LEVEL, DICTIONARY = 2048, 3, 1 << 16
#: Labelled texts a class to learn from, bytes of the longest of these, and how many longer ones where a class has no others.
ROWS, LONGEST, FEW = 1000, 1 << 14, 4
#: Scores from here on predict label 1.
GOOD = 0.7


def pieces(text: bytes, size: int = PIECE) -> list[bytes]:
    return [text[i : i + size] for i in range(0, len(text), size)]


def dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A zstandard dictionary of texts; their plain bytes where there are too few to train on."""
    parts = [p for t in texts for p in pieces(t, 512)]
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, parts)) // 8)), parts, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-size:]


@lru_cache(4)
def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    if not data:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)


def measures(text: bytes, good: bytes, bad: bytes) -> tuple[float, float, float]:
    """What the curve is fitted on: (size with the bad dictionary - size with the good one) and the smaller of both, over the bytes of the text (0 and 1
    for an empty one); and 1."""
    if not text:
        return 0.0, 1.0, 1.0
    parts = pieces(text)
    with_good, with_bad = (sum(len(c.compress(p)) for p in parts) for c in (_compressor(good), _compressor(bad)))
    return (with_bad - with_good) / len(text), min(with_good, with_bad) / len(text), 1.0


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> list[float]:
    """Weights of weighted logistic regression, by damped Newton steps on columns scaled to unit spread."""
    w = w / w.sum()
    scale = np.sqrt((w[:, None] * x * x).sum(0))
    scale[scale == 0] = 1
    z, beta = x / scale, np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -40, 40)))
        g = z.T @ (w * (y - p)) - ridge * beta
        h = (z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta))
        step = np.linalg.solve(h, g)
        step *= min(1, 2 / max(1e-12, float(np.abs(step).max())))
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return (beta / scale).tolist()


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, longest: int = LONGEST) -> dict:
    """The model: two dictionaries and the curve's weights.  At most 2 * rows texts of longest bytes come to the driver."""
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1)
        & F.col("doc_id").isNotNull() & ~held_out())
    share = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    model = {"good": b"", "bad": b"", "curve": [0.0, 0.0, 0.0]}
    if min(share.get(0, 0), share.get(1, 0)) < 2:
        p = (share.get(1, 0) + 1e-3) / (total + 2e-3)
        return model | {"curve": [0.0, 0.0, math.log(p / (1 - p))]}
    picked = None
    for q in (0, 1):  # bounded: a top-k of ids per class
        top = labels.where(F.col("quality") == q).dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"),
            "doc_id").limit(rows)
        picked = top if picked is None else picked.unionByName(top)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") > 0)
    labelled = texts.join(F.broadcast(picked), "doc_id")
    one = lambda rows: rows.groupBy("quality", "doc_id").agg(F.min("text").alias("text"))
    order = F.xxhash64(F.lit(1), "doc_id").alias("h")
    found = one(labelled.where(F.octet_length("text") <= longest)).select("quality", order, "text").collect()
    for q in {0, 1} - {r["quality"] for r in found}:
        found += one(labelled.where(F.col("quality") == q)).orderBy(F.octet_length("text"), "doc_id").limit(FEW).select("quality", order, "text").collect()
    seen: dict[int, list[bytes]] = {0: [], 1: []}
    for r in sorted(found, key=lambda r: (r["h"], r["text"])):
        seen[r["quality"]].append(r["text"].encode())
    held = {q: t[1::2] for q, t in seen.items()}
    model |= {name: dictionary(seen[q][0::2]) for name, q in (("bad", 0), ("good", 1))}
    if not held[0] or not held[1]:
        return model
    x = np.array([measures(t, model["good"], model["bad"]) for q in (0, 1) for t in held[q]])
    y = np.array([float(q) for q in (0, 1) for _ in held[q]])
    w = np.array([share[q] / total / len(held[q]) for q in (0, 1) for _ in held[q]])
    model["curve"] = logistic(x, y, w)
    return model


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""

    def work(part: pa.RecordBatch):
        x = np.array([measures(t, model["good"], model["bad"]) for t in utf8(part.column("text"))])
        p = 1 / (1 + np.exp(-np.clip(x @ np.array(model["curve"]), -700, 700)))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    scored = mapped(docs, work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias(
        "predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
