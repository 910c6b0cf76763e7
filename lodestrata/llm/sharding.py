"""Sharding by balanced label propagation, with DataFrame operations only.

Documents that share a link key (here: equal texts) are neighbours.  All start in the shard that a hash of their id, text and number among equal
rows names, so that the table's rows alone decide, however its files are split.  In each round every group of neighbours looks where most of its members
are, among shards with room, and the others move there.  A shard admits no more than its quota leaves: where more want in, groups come in the order of
a lot, whole as long as they fit, and those whose lots stand where room ends by their share.  Members of a group in
one shard are alike, so the rounds run over counts (group, shard, members), not over rows, and only the loads of the shards
come to the driver.  Then rows are dealt out by these counts, and rows without neighbours, who cut no edge anywhere, fill what is
left, so that the law `rows` holds: the shards' row counts are at most one apart.

Ranks (who fills what, and the slots) are sums over hash buckets plus a row's place in its bucket, so no shard or group
is ever sorted in one task.

Defined cases: a null text counts as empty (size 1, crc32 0, equal to other empty texts); equal rows are neighbours, in slots of their own;
fewer rows than shards leave shards empty; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SHARDS, ROUNDS, SEED = 8, 8, 17
#: Rows that a bucket should hold, and how many buckets there are at most; buckets of lots; equal rows that are numbered together.
BUCKET_ROWS, MOST_BUCKETS, LOTS, SPAN = 200, 1 << 20, 1024, 4096


def _pick(values: list, by: Column) -> Column:
    """values[by], as an expression."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by + 1).cast("int"))


def _ranked(rows: DataFrame, keys: list[str], buckets: Column, name: str) -> DataFrame:
    """Adds name: the place (from 0) of each row among those with its keys, in the order of bucket, h and row."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(3), "h"), buckets))
    by = [*keys, "bucket"]
    counts = rows.groupBy(*by).agg(F.count("*").alias("in_bucket"))
    over = Window.partitionBy(*keys).orderBy("bucket") if keys else Window.orderBy("bucket")
    offsets = counts.withColumn("offset", F.sum("in_bucket").over(over.rowsBetween(Window.unboundedPreceding,
        -1))).drop("in_bucket")
    inside = F.row_number().over(Window.partitionBy(*by).orderBy("h", "row"))
    return rows.withColumn("inside", inside).join(offsets, by).withColumn(name, (F.coalesce("offset", F.lit(0)) + F.col(
        "inside") - 1).cast("long")).drop("bucket", "inside", "offset")


def propagate(state: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """Moves members between shards: state (g1, g2, shard, n) to the same after some rounds.  No more than quota[s] members come into shard s."""
    state = materialize(state, "label-state")
    for turn in range(rounds):
        loads = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        free = [max(0, q - loads.get(s, 0)) for s, q in enumerate(quota)]
        open_ = _pick([f > 0 for f in free], F.col("shard"))
        tied = F.xxhash64("g1", "g2", "shard")  # which of a group's equal shards counts as the larger one
        ranked = state.withColumn("tie", tied)
        best = ranked.where(open_).groupBy("g1", "g2").agg(F.max(F.struct("n", "tie", "shard")).alias("best")).select(
            "g1", "g2", F.col("best.n").alias("best_n"), F.col("best.tie").alias("best_tie"), F.col("best.shard").alias(
            "to"))
        smaller = (F.col("n") < F.col("best_n")) | ((F.col("n") == F.col("best_n")) & (F.col("tie") < F.col(
            "best_tie")))
        wants = (F.col("to") != F.col("shard")) & (smaller | ~open_)  # a full shard lets its members go to where there is room
        moves = ranked.join(best, ["g1", "g2"], "left").withColumn("wants", F.when(F.coalesce(wants, F.lit(False)),
            F.col("n")).otherwise(0)).withColumn("lot", F.pmod(F.xxhash64(F.lit(turn), "g1", "g2"), F.lit(LOTS)))
        asked: dict[int, dict[int, int]] = {}
        for r in moves.where("wants > 0").groupBy("to", "lot").agg(F.sum("wants").alias("n")).collect():  # LOTS a shard at most
            asked.setdefault(r["to"], {})[r["lot"]] = r["n"]
        if not asked:
            break
        whole, part = [], []  # of each shard: lots below this come whole, those of this one by a share
        for s in range(len(quota)):
            room, lot, own = free[s], 0, asked.get(s, {})
            while lot < LOTS and own.get(lot, 0) <= room:
                room -= own.get(lot, 0)
                lot += 1
            whole.append(lot)
            part.append(room / own[lot] if lot < LOTS else 0.0)
        to = F.coalesce("to", F.lit(0))
        moved = F.when(F.col("lot") < _pick(whole, to), F.col("wants")).when(F.col("lot") == _pick(whole, to), F.floor(F.col(
            "wants") * _pick(part, to))).otherwise(0).cast("long")
        moves = moves.withColumn("moved", moved)
        stay = moves.select("g1", "g2", "shard", (F.col("n") - F.col("moved")).alias("n"))
        go = moves.where("moved > 0").select("g1", "g2", F.col("to").cast("int").alias("shard"), F.col("moved").alias(
            "n"))
        state = materialize(stay.unionByName(go).groupBy("g1", "g2", "shard").agg(F.sum("n").alias("n")).where("n > 0"),
            "label-state")
    return state


def shards(docs: DataFrame, n: int = SHARDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    columns = ["doc_id", "size", "text_crc32", "g1", "g2"]
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary"))
        .alias("text_crc32"), F.xxhash64(text).alias("g1"), F.xxhash64(F.lit(seed), text).alias("g2"))
    alike = materialize(rows.groupBy(*columns).agg(F.count("*").alias("times")), "shard-alike")
    few = alike.where(F.col("times") <= SPAN).withColumn("from", F.lit(1).cast("long"))
    many = alike.where(F.col("times") > SPAN).withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), "times", F.lit(SPAN).cast("long"))))
    spans = few.unionByName(many.repartition("g1", "from"))
    rows = spans.withColumn("nth", F.explode(F.sequence("from", F.least("times", F.col("from") + (SPAN - 1))))).select(*columns, F.struct("doc_id", "g1",
        "g2", "nth").alias("row"), F.xxhash64(F.lit(seed), "doc_id", "g1", "g2", "nth").alias("h"))
    rows = materialize(rows, "shard-rows")
    total = rows.count()
    buckets = F.lit(max(1, min(MOST_BUCKETS, total // (n * BUCKET_ROWS))))
    target = [total // n + (s < total % n) for s in range(n)]

    counts = rows.groupBy("g1", "g2", F.pmod("h", F.lit(n)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    members = F.sum("n").over(Window.partitionBy("g1", "g2"))  # n rows a group at most
    state = propagate(counts.withColumn("members", members).where("members > 1").drop("members"), target, rounds)

    # what is over a shard's target goes back into the pool, from all its groups alike
    loads = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    over = [max(0, loads.get(s, 0) - t) / max(1, loads.get(s, 0)) for s, t in enumerate(target)]
    kept = state.withColumn("n", F.col("n") - F.ceil(F.col("n") * _pick([float(x) for x in over], F.col("shard"))))
    up_to = F.sum("n").over(Window.partitionBy("g1", "g2").orderBy("shard"))
    size = state.groupBy("g1", "g2").agg(F.sum("n").alias("members"))
    plan = kept.withColumn("up_to", up_to).groupBy("g1", "g2").agg(F.array_sort(F.collect_list(F.struct("up_to",
        "shard"))).alias("plan")).join(size, ["g1", "g2"])  # n entries a group at most

    planned = materialize(rows.join(plan, ["g1", "g2"], "left"), "planned-rows")
    linked = _ranked(planned.where("plan is not null"), ["g1", "g2"], F.ceil(F.col("members") / BUCKET_ROWS).cast(
        "long"), "place")
    linked = linked.withColumn("shard", F.expr("try_element_at(filter(plan, x -> x.up_to > place), 1).shard"))
    columns = ["row", "h", "doc_id", "size", "text_crc32"]
    placed = materialize(linked.select(*columns, "shard").unionByName(planned.where("plan is null").select(*columns,
        F.lit(None).cast("int").alias("shard"))), "placed-rows")

    used = {r["shard"]: r["n"] for r in placed.where("shard is not null").groupBy("shard").agg(F.count("*").alias("n"))
        .collect()}
    ends = [sum(target[i] - used.get(i, 0) for i in range(s + 1)) for s in range(n)]
    pool = _ranked(placed.where("shard is null").drop("shard"), [], buckets * n, "place")
    fill = reduce(lambda rest, s: F.when(F.col("place") < ends[s], F.lit(s)).otherwise(rest), range(n - 2, -1, -1),
        F.lit(n - 1))
    done = placed.where("shard is not null").select(*columns, "shard").unionByName(pool.select(*columns, fill.cast(
        "int").alias("shard")))
    done = _ranked(materialize(done, "sharded-rows"), ["shard"], buckets, "slot")
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast(
        "int").alias("grown_shard"))
