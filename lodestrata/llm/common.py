"""What the operators of this subpackage share: Arrow batches, checkpoints, words."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that an operator looks at together in a Python worker (a longer text is looked at by itself).
CHUNK_BYTES = 1 << 20


def ready(spark: SparkSession) -> None:
    """Lets Python workers of the same machine import this package, wherever the driver was started."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or that of the context's checkpoints.  Where neither is set, one of our own if Spark
    runs on this machine alone; on a cluster that is an error, as executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + str(Path(tempfile.gettempdir()) / "lodestrata-checkpoints")
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestrata/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The name under which columns that an operator does not look at travel through it, as one struct.
CARRIED = "carried_columns"


def quoted(column: str) -> Column:
    """The column of this name, whatever the name."""
    return F.col("`" + column.replace("`", "``") + "`")


#: The columns of documents that operators look at.
OWN = ("doc_id", "text", "lang", "source")


def packed(docs: DataFrame, own: tuple[str, ...] = OWN) -> DataFrame:
    """docs with its columns named in own as they are and all others as one struct."""
    others = [quoted(c) for c in docs.columns if c not in own]
    return docs.select(*[c for c in docs.columns if c in own], *([F.struct(*others).alias(CARRIED)] if others else []))


def unpacked(df: DataFrame, columns: list[str], own: tuple[str, ...] = OWN) -> DataFrame:
    """These columns of df, whose others than own packed() has put away."""
    return df.select(*[(F.col(c) if c in own else F.col(CARRIED).getField(c)).alias(c) for c in columns])


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2.  A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each, a row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def release() -> None:
    """Gives memory that a task is done with back to the system: workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: T.StructType | str,
    column: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """df.mapInArrow over slices of bounded size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for part in chunks(batch, column, limit):
                    yield from work(part)
        finally:
            release()

    return df.mapInArrow(run, schema)


class Numbers(dict):
    """Numbers words as they come: a dict that answers an unknown key with its size."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def numbered_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Numbers]:
    """The words ([^\\x20\\x09-\\x0D]+) of all texts as numbers, where each text starts (one more at the end), and the numbering.

    bytes.split() parts at exactly the six ASCII white-space bytes."""
    numbers, lengths, words = Numbers(), [], []
    for t in texts:
        own = t.split()
        lengths.append(len(own))
        words += own
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    return ids, np.concatenate([[0], np.cumsum(np.asarray(lengths, np.int64))]).astype(np.int64), numbers


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Letters of a word that the table below covers; a longer word is hashed whole by xxh3.
SHORT = 48
#: A random number for each place in a word and each byte there (tabulation hashing).
_TABLE = _mix(_mix(np.arange(1, SHORT * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word ([^\\x20\\x09-\\x0D]+) of all texts, and where each text starts (one more at the end).

    The sum of random numbers of its letters in their places, spread: a handful of numpy operations a byte, whatever the
    vocabulary.  Every letter of a word counts, however long it is."""
    joined = b"\n".join([*texts, b""])
    data = np.frombuffer(joined, np.uint8)
    space = _SPACE[data]
    edge = np.empty(len(data), bool)
    if len(data):
        edge[0], edge[1:] = True, space[:-1]
    begin = np.flatnonzero(~space & edge)
    size = np.flatnonzero(space & ~edge) - begin
    letters = data[~space]
    at = (np.cumsum(size) - size).astype(np.int64)
    cell = np.arange(len(letters), dtype=np.int32) - np.repeat(at.astype(np.int32), size)
    long = np.flatnonzero(size > SHORT)
    if len(long):
        np.minimum(cell, SHORT - 1, out=cell)
    cell *= 256
    cell += letters
    sums = np.add.reduceat(_TABLE[cell], at) if len(at) else np.zeros(0, np.uint64)
    for i in long.tolist():
        sums[i] = xxhash.xxh3_64_intdigest(joined[begin[i] : begin[i] + size[i]])
    edges = np.concatenate([[0], np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))])
    return _mix(sums ^ _mix(size.astype(np.uint64))), np.searchsorted(begin, edges).astype(np.int64)
