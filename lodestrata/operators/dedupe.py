"""Distinct rows with a defined survivor, numbering, and sets of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the first in order, which must end in something unique.  By plain columns it is an aggregate, combined before the shuffle."""
    if all(isinstance(c, str) for c in order):
        rest = [c for c in df.columns if c not in keys]
        best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop(
        "_rn")


def keep_last(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row a key: the last by an ordinal, as a map filled in that order keeps it.  An aggregate, so partial results combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def capped(df: DataFrame, keys: list[str], group: list[str], order: list, most: int) -> DataFrame:
    """First row of each key, and of these the first `most` of each group."""
    kept = keep_first(df, keys, order)
    return kept.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(
        "_rn") <= most).drop("_rn")


def short_hashes(df: DataFrame, value: Column, size: int = 12, step: int = 4) -> DataFrame:
    """Adds short_id: the shortest prefix of the value's SHA-256, from size in steps, that no other value has.

    All lengths are counted at once, in one pass over exploded prefixes, instead of a loop until nothing collides."""
    hashed = df.withColumn("_h", F.sha2(value, 256))
    sizes = F.array(*[F.lit(n) for n in range(size, 65, step)])
    values = hashed.select("_h").distinct()
    prefixes = values.select("_h", F.explode(sizes).alias("_n")).withColumn("_p", F.substr("_h", F.lit(1), F.col("_n")))
    unique = prefixes.groupBy("_p", "_n").agg(F.count("*").alias("_c"), F.min("_h").alias("_h")).where(
        "_c = 1").groupBy("_h").agg(F.min("_n").alias("_n"))
    return hashed.join(unique, "_h").withColumn("short_id", F.substr("_h", F.lit(1), F.col("_n"))).drop("_h", "_n")


def dictionary(df: DataFrame, column: str, ordinal: str) -> DataFrame:
    """Codes from 0 for the distinct values of a column, in the order in which they first come.

    Positions are sums over ranges of the ordinal, so no task sorts all values."""
    firsts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(ordinal).alias("_first"))
    return with_number(firsts, ["_first", column], "code").drop("_first")


def with_number(df: DataFrame, order: list[str], name: str, buckets: int = 64) -> DataFrame:
    """Adds a gapless number from 0 in a total order: a range partitioning, kept in a table as it fell, counts a partition, and places within partitions."""
    from .graph import settled

    spread = settled(df.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # `buckets` rows
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return spread.withColumn("_in", inside).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before")
        + F.col("_in") - 1).cast("long")).drop("_part", "_in", "_before")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def rebased(previous_base: Column, user: Column, next_base: Column) -> Column:
    """The user's removals from and additions to a list, applied to a new base."""
    removed, added = F.array_except(previous_base, user), F.array_except(user, previous_base)
    return F.array_sort(F.array_union(F.array_except(next_base, removed), added))


def same_set(left: Column, right: Column) -> Column:
    """Whether two lists hold the same values; two empty lists do not count."""
    return (F.size(left) > 0) & (F.array_sort(F.array_distinct(left)) == F.array_sort(F.array_distinct(right)))
