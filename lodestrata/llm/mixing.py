"""Mixing sources to target weights by hierarchical budgeting.

The budget of tokens runs down a tree (domain, language, source): a node's budget is shared among its children by their weights, no child
getting more than its leaves hold in `epochs` passes.  What a child cannot take goes to its siblings, again by weight; only what a
whole family cannot take goes to the families beside it, and so on up.  A leaf's budget is some whole passes over its
documents and, of one more pass, a prefix by tokens in an order of that pass's own, drawn from a seed.

Such a prefix is all documents up to some hash: the leaf's documents are summed up in hash buckets, the bucket in which the budget ends is
found from the sums, and only its documents are sorted.  So what the operator decides is one row a leaf (whole passes, last
hash), and documents are selected by a filter: texts are never shuffled.

Defined cases: a null text has no tokens; documents without tokens are taken in every whole pass and with every prefix that
reaches their hash; null labels make a child named `none`; rows alike in id and text have one hash and go together; a
budget beyond what epochs can give leaves the rest unspent; an empty table gives an empty result; further columns are kept, save those that
select() adds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BUCKET_BITS, SEED = 12, 29
#: Leaves up to which the decisions are broadcast (a row of some 100 bytes each).
BROADCAST_LEAVES = 50_000

Weight = Callable[[tuple[str, ...]], float]


def share(budget: int, weights: Mapping[str, float], limits: Mapping[str, int]) -> dict[str, int]:
    """Whole parts of budget by weight, none above its limit; what one cannot take goes to the others by weight.  Rounding favours larger remainders, then names."""
    out = dict.fromkeys(weights, 0)
    open_ = sorted(k for k in weights if weights[k] > 0 and limits[k] > 0)
    left = min(budget, sum(limits[k] for k in open_))
    while left and open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / total >= limits[k] - out[k]]
        if full:
            for k in full:
                left -= limits[k] - out[k]
                out[k] = limits[k]
            open_ = [k for k in open_ if k not in full]
            continue
        exact = {k: left * weights[k] / total for k in open_}
        for k in open_:
            out[k] += int(exact[k])
        rest = left - sum(int(x) for x in exact.values())
        for k in sorted(open_, key=lambda k: (int(exact[k]) - exact[k], k)):
            if rest > 0 and out[k] < limits[k]:
                out[k], rest = out[k] + 1, rest - 1
        left = 0
    return out


def budgets(supply: Mapping[tuple[str, ...], int], weight: Weight, total: int, epochs: int) -> dict[tuple[str, ...],
    int]:
    """The token budget of each leaf (a path), from each leaf's tokens and the weight of every node among its siblings."""
    limit: dict[tuple[str, ...], int] = {}
    children: dict[tuple[str, ...], set[str]] = {}
    for path, tokens in supply.items():
        for depth in range(len(path) + 1):
            limit[path[:depth]] = limit.get(path[:depth], 0) + tokens * epochs
            if depth:
                children.setdefault(path[: depth - 1], set()).add(path[depth - 1])
    out: dict[tuple[str, ...], int] = {}
    stack: list[tuple[tuple[str, ...], int]] = [((), min(total, limit.get((), 0)))]
    while stack:
        path, budget = stack.pop()
        if path not in children:
            out[path] = budget
            continue
        names = children[path]
        for name, part in share(budget, {c: weight((*path, c)) for c in names}, {c: limit[*path, c]
            for c in names}).items():
            stack.append(((*path, name), part))
    return {p: b for p, b in out.items() if p}


def tokens_of(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _labelled(docs: DataFrame, levels: Iterable[Column]) -> DataFrame:
    return docs.withColumns({f"mix_level_{i}": F.coalesce(c.cast("string"), F.lit("none")) for i,
        c in enumerate(levels)})


def _rank(epoch: Column, seed: int) -> Column:
    """A document's place in a pass: a hash of 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, F.col("doc_id"), F.col("text")), 1)


def decide(docs: DataFrame, levels: list[Column], weight: Callable[[dict], Weight], total: float, epochs: int,
    seed: int = SEED) -> DataFrame:
    """A row a leaf: its labels (mix_level_*), tokens, budget, whole passes (passes) and the last hash of one more pass (last, -1 for none).

    weight makes the nodes' weights from the leaves' tokens; total is the budget as a share of all tokens."""
    spark, names = docs.sparkSession, [f"mix_level_{i}" for i in range(len(levels))]
    rows = _labelled(docs, levels).select(*names, "doc_id", "text", tokens_of().alias("tokens"))
    supply = {tuple(r[n] for n in names): r["tokens"] for r in rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
        .collect()}  # the tree's leaves
    wanted = budgets(supply, weight(supply), round(total * sum(supply.values())), epochs)
    plan = [(*p, supply[p], wanted.get(p, 0), *(divmod(wanted.get(p, 0), supply[p]) if supply[p] else (0, 0)))
        for p in sorted(supply)]
    schema = ", ".join(f"{n} string" for n in names) + ", tokens long, budget long, passes long, rest long"
    leaves = spark.createDataFrame(plan, schema)
    few = (lambda df: F.broadcast(df)) if len(plan) <= BROADCAST_LEAVES else (lambda df: df)
    placed = rows.join(few(leaves.where("rest > 0").select(*names, "passes", "rest")), names).withColumn("h",
        _rank(F.col("passes"), seed))
    placed = materialize(placed.select(*names, "rest", "tokens", "h"), "mix-places")
    bucket = F.shiftrightunsigned("h", 63 - BUCKET_BITS)
    sums = placed.groupBy(*names, "rest", bucket.alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.max("h").alias(
        "h"))  # leaves times 2**BUCKET_BITS rows at most
    upto = sums.withColumn("upto", F.sum("tokens").over(Window.partitionBy(*names).orderBy("bucket")))
    whole = upto.where("upto <= rest").groupBy(*names).agg(F.max("h").alias("whole"), F.max("upto").alias("before"))
    cut = upto.where("upto > rest").groupBy(*names, "rest").agg(F.min("bucket").alias(
        "bucket"))  # a prefix ends in the first bucket that does not fit whole
    cut = cut.join(whole, names, "left").select(*names, "rest", "bucket", F.coalesce("before", F.lit(0)).alias(
        "before"))
    edge = placed.drop("rest").withColumn("bucket", bucket).join(few(cut), [*names, "bucket"]).groupBy(*names, "rest",
        "before", "h").agg(F.sum("tokens").alias("tokens"))
    edge = edge.withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy(*names).orderBy(
        "h"))).where("upto <= rest").groupBy(*names).agg(F.max("h").alias("inside"))
    last = F.coalesce(F.col("inside"), F.col("whole"), F.lit(-1)).alias("last")
    return materialize(leaves.join(whole, names, "left").join(edge, names, "left").select(*names, "tokens", "budget",
        "passes", last), "mix-decisions")


def select(docs: DataFrame, levels: list[Column], weight: Callable[[dict], Weight], total: float, epochs: int,
    seed: int = SEED) -> DataFrame:
    """The rows of docs that the mix takes, with copies: how many times."""
    decisions = decide(docs, levels, weight, total, epochs, seed)
    names = [f"mix_level_{i}" for i in range(len(levels))]
    rows = _labelled(docs.drop("copies"), levels)
    plan = decisions.select(*names, "passes", "last")
    plan = F.broadcast(plan) if decisions.count() <= BROADCAST_LEAVES else plan
    taken = rows.join(plan, names).withColumn("copies", (F.col("passes") + F.when(_rank(F.col("passes"), seed) <= F.col(
        "last"), 1).otherwise(0)).cast("int"))
    return taken.where("copies > 0").drop("passes", "last")


def smoothed(power: float) -> Callable[[dict], Weight]:
    """Weights of nodes: their tokens to some power (1: as they come, 0: all alike)."""

    def of(supply: dict) -> Weight:
        total: dict[tuple, int] = {}
        for path, tokens in supply.items():
            for depth in range(1, len(path) + 1):
                total[path[:depth]] = total.get(path[:depth], 0) + tokens
        return lambda path: float(total[path]) ** power if total[path] else 0.0

    return of


def domain_of(source: str = "source") -> Column:
    """The documents name no domain; a source's number modulo 4 stands in for it."""
    number = F.regexp_extract(F.col(source), r"(\d{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), F.pmod(number.cast("int"), F.lit(4)).cast("string")))
