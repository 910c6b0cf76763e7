"""The prefix trie of conversations by Patricia construction.

Conversations are sorted by their turns, and neighbours compared: where two part is a branch point, where one ends an end point.  Only these
points (and the root) are created, each at the end of a compressed edge that stands for all nodes from its parent point on.  Aggregates are
computed over points; the nodes inside an edge, which have one child each, are expanded last: they share their point's conversations
and leaves, and what they save is the point's sum and a suffix sum over the edge.

A turn is known by two 64-bit hashes of role and text, a prefix by the exclusive or of hashes of its turns in their places, so that texts stay where they
are read.  Copies of a conversation are one sequence from the start.  Conversations and positions are sorted by ranges, and running values are
carried over the ranges' borders, so no conversation, first turn or group of copies is one task's: a border is a row or two a range.  Sequences are
compared in blocks of turns, and only those that are alike throughout a block go on to the next, longer one: the rows to sort
are as long as a block, whatever the longest conversation.

Defined cases: turns are ordered by number, null first, and then by role and text; a null role or text is empty; rows without conv_id are no
conversation's; equal rows are turns of their own; a conversation may be left without turns and then ends at the root; an empty table gives an empty
result; further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Turns in the first block that is compared, and in the longest; conversation ids hashed together; nodes of an edge laid out together.
BLOCK, MOST_BLOCK, CHUNK_BYTES, SPAN = 32, 1024, 1 << 16, 4096
EMPTY = hashlib.sha256(b"").hexdigest()


def _ranges(df: DataFrame) -> int:
    """Ranges to sort into: as many as the session's shuffles have."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds, in order within each key, place (from 1), and over the columns f1, f2 running exclusive ors and over chars a running sum.

    Ranges of (key, order) are read in order; what a range begins with in the middle of a key gets what earlier ranges hold of that key.  The columns
    that are replaced need not be there."""
    has = [c for c in ("f1", "f2", "chars") if c in df.columns]
    spread = df.repartitionByRange(_ranges(df), key, *order).sortWithinPartitions(key, *order)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    added = ["place", *[f"run_{c}" for c in has]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, [0] * len(added)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy(zero_copy_only=False)
            fresh = np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
            first = not fresh[0]
            carried = int(np.argmax(fresh)) if fresh.any() else len(keys)  # rows that go on with the last batch's key
            outs = []
            for i, c in enumerate(added):
                if c == "place":
                    out = np.arange(len(keys), dtype=np.int64) - begin + 1
                    if first:
                        out[:carried] += held[i]
                else:
                    v = batch.column(c.removeprefix("run_")).to_numpy(zero_copy_only=False).astype(np.int64)
                    if c == "run_chars":
                        total = np.cumsum(v)
                        out = total - (total - v)[begin]
                        if first:
                            out[:carried] += held[i]
                    else:
                        total = np.bitwise_xor.accumulate(v)
                        out = total ^ (total ^ v)[begin]
                        if first:
                            out[:carried] ^= held[i]
                outs.append(out)
            last, held = keys[-1], [int(o[-1]) for o in outs]
            columns = [*batch.columns, *map(pa.array, outs), pa.array(np.full(len(keys), part, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *added, "part"])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in df.columns], *[f"{c} long" for c in added], "part int"])
    kept = materialize(spread.mapInArrow(run, schema), name)
    # of each range the totals of its last key, which alone may go on in the next one
    ends = kept.groupBy("part").agg(F.max_by(F.struct(F.col(key).alias("key"), *added), F.struct(key, "place")).alias("e")).select("part", "e.*")
    heads = kept.groupBy("part").agg(F.min(key).alias("first"))
    carry = heads.alias("h").join(ends.alias("e"), (F.col("h.first") == F.col("e.key")) & (F.col("e.part") < F.col("h.part"))).groupBy(F.col(
        "h.part").alias("part"), F.col("h.first").alias("first")).agg(*[(F.sum if c in ("place", "run_chars") else F.bit_xor)(f"e.{c}").alias(f"c_{c}")
        for c in added])
    # as many rows as ranges
    joined = kept.join(F.broadcast(carry), (kept["part"] == carry["part"]) & (kept[key] == carry["first"]), "left")
    whole = {c: kept[c] + F.coalesce(carry[f"c_{c}"], F.lit(0)) if c in ("place", "run_chars") else kept[c].bitwiseXOR(F.coalesce(carry[f"c_{c}"],
        F.lit(0))) for c in added}
    return joined.select(*[kept[c] for c in df.columns if c not in has], *[whole[c].alias(c.removeprefix("run_")) for c in added], *[kept[c].alias(
        f"own_{c}") for c in has])


def turns_of(conversations: DataFrame) -> DataFrame:
    """Per turn: conv_id, place (from 1), two hashes of its role and text, and the code points of its text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"))
    hashed = rows.select("conv", "turn", F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit("turn"), "role").alias("h2"),
        F.length("text").cast("long").alias("size"))
    # only where several turns of a conversation have one number do role and text order them
    tied = hashed.groupBy("conv", "turn").agg((F.min("h1") < F.max("h1")).alias("differ")).where("differ").select("conv", F.col("turn").alias("t"))
    named = rows.join(tied, (rows["conv"] == tied["conv"]) & rows["turn"].eqNullSafe(tied["t"]), "left_semi").distinct()
    spread = materialize(named.repartitionByRange(_ranges(rows), "conv", "turn", "role", "text").withColumn("part", F.spark_partition_id()), "trie-ties")
    rank = spread.select("conv", "turn", F.xxhash64("role", "text").alias("h1"), "part", F.row_number().over(Window.partitionBy("part").orderBy("conv",
        "turn", "role", "text")).alias("nth"))
    ranked = hashed.join(rank.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("h1").alias("h"), "part", "nth"), (F.col("conv") == F.col(
        "c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("h1") == F.col("h")), "left")
    return running(ranked.select("conv", "turn", F.coalesce("part", F.lit(0)).alias("tie"), F.coalesce("nth", F.lit(0)).alias("nth"), "h1", "h2", "size"),
        "conv", ["turn", "tie", "nth"], "trie-turns").select("conv", "place", "h1", "h2", "size")


def rebuilt(turns: DataFrame, conv: DataFrame, family: int = 100, heads: int = 6) -> DataFrame:
    """Per turn of a rebuilt conversation: conv, depth (from 1), h1, h2, size.

    Conversation c begins with the first h turns of the first of its family, c - c % family, and goes on with its own turns after its first h; h is
    a hash of c modulo heads."""
    c = F.col("conv")
    known = conv.select("conv", (c - c % family).alias("base"), (F.crc32(c.cast("string").cast("binary")) % heads).cast("int").alias("h"))
    first = turns.where((c % family == 0) & (F.col("place") < heads)).groupBy(c.alias("base")).agg(F.array_sort(F.collect_list(F.struct("place", "h1", "h2",
        "size"))).alias("head"))  # heads - 1 turns at most
    lent = known.join(first, "base", "left").select("conv", "h", F.slice(F.coalesce("head", F.array().cast(first.schema["head"].dataType)), F.lit(1),
        F.col("h")).alias("head"))
    head = lent.select("conv", F.explode("head").alias("t")).select("conv", F.col("t.place").alias("depth"), "t.h1", "t.h2", "t.size")
    # how many turns a conversation has after its first h is a matter of its own rows; how many it is lent, of its base's first turns
    own = turns.withColumn("base", c - c % family).withColumn("h", (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")).where("place > h")
    own = own.join(first.select("base", F.size("head").alias("lent")), "base", "left")
    tail = own.select("conv", (F.least("h", F.coalesce("lent", F.lit(0))) + F.col("place") - F.col("h")).alias("depth"), "h1", "h2", "size")
    return head.unionByName(tail)


def alike(x: str, y: str) -> Column:
    """How many of the first values of two pairs of arrays (x1, x2 and y1, y2) are the same."""
    first, second = (F.zip_with(f"{x}{i}", f"{y}{i}", lambda a, b: a.eqNullSafe(b)) for i in (1, 2))
    same = F.zip_with(first, second, lambda a, b: a & b)
    at = F.array_position(same, False)
    return F.when(at > 0, at - 1).otherwise(F.size(same)).cast("long")


def parted(prefixes: DataFrame, sequences: DataFrame) -> DataFrame:
    """Per pair of neighbours in sorted order: seq and other, and depth, up to which they are the same.  Prefixes: seq, depth, f1, f2."""
    active = sequences.select("seq", F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2"))
    start, block, found = 0, BLOCK, None
    while True:
        end = start + block
        inside = prefixes.where((F.col("depth") > start) & (F.col("depth") <= end))
        if start:
            inside = inside.join(active.select("seq"), "seq", "left_semi")
        keys = inside.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("depth", "f1", "f2"))).alias("b"))  # `block` turns at most
        none = F.array().cast("array<long>")
        keys = active.join(keys, "seq", "left").select("seq", "g1", "g2", F.coalesce("b.f1", none).alias("a1"), F.coalesce("b.f2", none).alias("a2"))
        spread = keys.repartitionByRange(_ranges(keys), "g1", "g2", "a1", "a2").sortWithinPartitions("g1", "g2", "a1", "a2")
        pairs = materialize(spread.mapInArrow(_neighbours, "part int, seq long, other long, depth long, edge int, g1 long, g2 long, a1 array<long>, "
            "a2 array<long>"), "trie-neighbours")
        # the last sequence of a range and the first of the next one that has any: two rows a range
        w = Window.orderBy("part", "edge")
        border = pairs.where("edge > 0").select("*", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("seq", "edge", "g1", "g2", "a1", "a2")]).where(
            "edge = 2 and n_seq is not null and g1 = n_g1 and g2 = n_g2")
        border = border.select("seq", F.col("n_seq").alias("other"), F.col("a1").alias("x1"), F.col("a2").alias("x2"), F.col("n_a1").alias("y1"), F.col(
            "n_a2").alias("y2")).select("seq", "other", alike("x", "y").alias("depth"))
        own = materialize(pairs.where("edge = 0").select("seq", "other", "depth").unionByName(border), "trie-parted")
        done = own.where(F.col("depth") < block).withColumn("depth", F.col("depth") + start)
        found = done if found is None else found.unionByName(done)
        on = own.where(F.col("depth") == block)
        if on.isEmpty():
            return found
        both = on.select(F.explode(F.array("seq", "other")).alias("seq")).distinct()
        at = prefixes.where(F.col("depth") == end)
        active = materialize(both.join(at, "seq").select("seq", F.col("f1").alias("g1"), F.col("f2").alias("g2")), "trie-active")
        start, block = end, min(2 * block, MOST_BLOCK)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted range: a row for each two neighbours of one group, and its first and last row with their keys (edge 1 and 2)."""
    part, last = TaskContext.get().partitionId(), None
    names = ["part", "seq", "other", "depth", "edge", "g1", "g2", "a1", "a2"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    edge = lambda row, n: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, row[0], None, None, n, row[1], row[2],
        row[3].tolist(), row[4].tolist()), types)], names=names)
    for batch in batches:
        a1, a2 = batch.column("a1"), batch.column("a2")
        at, v1, v2 = a1.offsets.to_numpy(), a1.values.to_numpy(), a2.values.to_numpy()
        shift = a2.offsets.to_numpy()
        seq, other, depth = [], [], []
        for i, (s, g1, g2) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("seq", "g1", "g2")))):
            row = (s, g1, g2, v1[at[i] : at[i + 1]], v2[shift[i] : shift[i + 1]])
            if last is None:
                yield edge(row, 1)
            elif last[1:3] == row[1:3]:
                n = min(len(last[3]), len(row[3]))
                differ = np.flatnonzero((last[3][:n] != row[3][:n]) | (last[4][:n] != row[4][:n]))
                seq.append(last[0])
                other.append(s)
                depth.append(int(differ[0]) if len(differ) else n)
            last = row
        if seq:
            n = len(seq)
            columns = [[part] * n, seq, other, depth, [0] * n, *[[None] * n] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    if last is not None:
        yield edge(last, 2)


def ends_hashed(ends: DataFrame) -> DataFrame:
    """Per sequence (f1, f2): the SHA-256 of its conversations' ids, ascending and joined by commas.

    Ids are joined within ranges first, so that what a large group's one task reads in the end, and hashes as it comes, is a few long texts."""
    keys = ["f1", "f2"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, ids, size = None, None, [], 0
        row = lambda: {"f1": held[0], "f2": held[1], "first": first, "ids": ",".join(ids)}
        for batch in batches:
            out = []
            for f1, f2, c in zip(*(batch.column(x).to_pylist() for x in ("f1", "f2", "conv"))):
                if (f1, f2) != held or size > CHUNK_BYTES:
                    if held is not None:
                        out.append(row())
                    held, first, ids, size = (f1, f2), c, [], 0
                ids.append(str(c))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_pylist(out)
        if held is not None:
            yield pa.RecordBatch.from_pylist([row()])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            out = []
            for f1, f2, text in zip(*(batch.column(x).to_pylist() for x in ("f1", "f2", "ids"))):
                if (f1, f2) == held:
                    state.update(b"," + text.encode())
                    continue
                if held is not None:
                    out.append({"f1": held[0], "f2": held[1], "ends_sha256": state.hexdigest()})
                held, state = (f1, f2), hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_pylist(out)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"f1": held[0], "f2": held[1], "ends_sha256": state.hexdigest()}])

    spread = ends.select("f1", "f2", "conv").repartitionByRange(_ranges(ends), "f1", "f2", "conv").sortWithinPartitions("f1", "f2", "conv")
    joined = spread.mapInArrow(join, "f1 long, f2 long, first long, ids string")
    return joined.repartition(*keys).sortWithinPartitions(*keys, "first").mapInArrow(digest, "f1 long, f2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = materialize(turns_of(conversations), "trie-places")
    conv = turns.select("conv").distinct()
    steps = rebuilt(turns, conv).select("conv", "depth", F.xxhash64("depth", "h1", "h2").alias("f1"), F.xxhash64("h2", "depth", "h1").alias("f2"), F.col(
        "size").alias("chars"))
    prefixes = materialize(running(steps, "conv", ["depth"], "trie-running").select("conv", "depth", "f1", "f2", "chars", F.col("own_chars").alias("size")),
        "trie-prefixes")
    zero = F.lit(0).cast("long")
    last = prefixes.groupBy("conv").agg(F.max("depth").alias("depth")).join(prefixes, ["conv", "depth"])
    ends = conv.join(last, "conv", "left").select("conv", *[F.coalesce(c, zero).alias(c) for c in ("depth", "f1", "f2", "chars")])
    ends = materialize(ends, "trie-ends")
    sequences = materialize(ends.groupBy("f1", "f2").agg(F.count("*").alias("n"), F.min("conv").alias("seq"), F.max("depth").alias("length"), F.max(
        "chars").alias("chars")), "trie-sequences")
    own = materialize(prefixes.withColumnRenamed("conv", "seq").join(sequences.select("seq"), "seq", "left_semi"), "trie-own")

    apart = materialize(parted(own, sequences), "trie-apart")
    shared = apart.select(F.explode(F.array("seq", "other")).alias("seq"), "depth").groupBy("seq").agg(F.max("depth").alias("shared"))
    sequences = materialize(sequences.join(shared, "seq", "left").withColumn("shared", F.coalesce("shared", F.lit(-1).cast("long"))), "trie-shared")
    forks = apart.where("depth > 0").select("seq", "depth").distinct().join(own, ["seq", "depth"]).select("f1", "f2").distinct()

    # the points on each sequence's path: what it shares holds all of them but its own end
    facts = sequences.select("seq", "n", "length", "shared", (F.col("shared") < F.col("length")).alias("leaf"))
    passed = own.join(facts, "seq").where((F.col("depth") <= F.col("shared")) & (F.col("depth") < F.col("length"))).join(forks, ["f1", "f2"], "left_semi")
    passed = passed.select("seq", "depth", "f1", "f2", "chars", "n", "leaf", F.lit(False).alias("end"))
    stops = sequences.where("length > 0").select("seq", F.col("length").alias("depth"), "f1", "f2", "chars", "n", (F.col("shared") < F.col(
        "length")).alias("leaf"), F.lit(True).alias("end"))
    roots = sequences.select("seq", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), zero.alias("chars"), "n", (F.col("shared") < F.col("length"))
        .alias("leaf"), (F.col("length") == 0).alias("end"))
    w = Window.partitionBy("seq").orderBy("depth")
    paths = materialize(passed.unionByName(stops).unionByName(roots).select("*", *[F.lag(c).over(w).alias(f"up_{c}") for c in ("depth", "f1", "f2", "chars")]),
        "trie-paths")
    points = materialize(paths.groupBy("f1", "f2").agg(F.min("seq").alias("seq"), F.sum("n").alias("n_convs"), F.sum(F.col("leaf").cast("long")).alias(
        "n_leaves"), F.max("end").alias("end"), *[F.max(c).alias(c) for c in ("depth", "chars", "up_depth", "up_f1", "up_f2", "up_chars")]), "trie-points")

    # an edge's savings count for all points above: its first sequence carries them up its path
    edges = points.where("depth > 0").select("seq", "depth", ((F.col("n_convs") - 1) * (F.col("chars") - F.col("up_chars"))).alias("saves"))
    up = Window.partitionBy("seq").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    saved = paths.select("seq", "depth", "f1", "f2").join(edges, ["seq", "depth"], "left").select("f1", "f2", F.sum(F.coalesce("saves", zero)).over(up).alias(
        "saves")).groupBy("f1", "f2").agg(F.sum("saves").alias("saved"))
    children = points.where("depth > 0").groupBy(F.col("up_f1").alias("f1"), F.col("up_f2").alias("f2")).agg(F.count("*").alias("children"))
    parents = points.select(F.col("f1").alias("up_f1"), F.col("f2").alias("up_f2"), F.col("seq").alias("parent"))
    whole = points.join(saved, ["f1", "f2"]).join(children, ["f1", "f2"], "left").join(ends_hashed(ends), ["f1", "f2"], "left").join(parents, ["up_f1",
        "up_f2"], "left")
    whole = materialize(whole.select("seq", "depth", "up_depth", "up_chars", "parent", "n_convs", "n_leaves", "saved", F.coalesce("children", zero).alias(
        "children"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")), "trie-whole")

    # each edge's nodes, in spans, with the lengths that its first sequence has there
    begin = F.explode(F.sequence(F.col("up_depth") + 1, F.col("depth"), F.lit(SPAN).cast("long")))
    spans = whole.where("depth > 0").withColumn("begin", begin)
    nodes = spans.withColumn("at", F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + (SPAN - 1), "depth"))))
    lengths = own.select("seq", F.col("depth").alias("at"), F.col("chars").alias("total"), "size")
    point = F.col("at") == F.col("depth")
    above = F.col("total") - F.col("size") - F.col("up_chars")  # what the nodes above this one on its edge have
    inner = nodes.join(lengths, ["seq", "at"]).select(F.col("seq").alias("conv_id"), F.col("at").alias("depth"), F.when(F.col("at") == F.col("up_depth") + 1,
        F.col("parent")).otherwise(F.col("seq")).alias("parent_conv_id"), "n_convs", F.when(point, F.col("children")).otherwise(1).cast("long").alias(
        "n_children"), "n_leaves", (F.col("saved") - (F.col("n_convs") - 1) * above).alias("saved_tokens"), F.when(point, F.col("ends_sha256")).otherwise(
        EMPTY).alias("ends_sha256"))
    root = whole.where("depth = 0").select(F.col("seq").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.col(
        "children").alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
    return inner.unionByName(root)
