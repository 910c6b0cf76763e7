"""Sequence diagrams: participants and messages, ranked, numbered, filtered, checked; and greedy selection under a budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_PARTICIPANTS, MOST_MESSAGES = 14, 40


def numbered(messages: DataFrame, by: str, order: list[str], most: int = MOST_MESSAGES) -> DataFrame:
    """Messages of each diagram numbered from 1 in order, up to a cap."""
    return messages.withColumn("sequence", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(
        "sequence") <= most)


def ranked(participants: DataFrame, by: str, rank: Column, most: int = MOST_PARTICIPANTS) -> DataFrame:
    return participants.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(rank,
        "id"))).where(F.col("place") <= most)


def filtered(messages: DataFrame, text: str, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Messages of some kinds with text in an end or in themselves, and the participants that are left (diagram, participant)."""
    said = F.lower(F.concat_ws(" ", "sender", "receiver", "text"))
    kept = messages.where(F.contains(said, F.lit(text.lower())) & (F.col("kind").isin(kinds) if kinds else F.lit(True)))
    return kept, kept.select("diagram", F.explode(F.array("sender", "receiver")).alias("participant")).distinct()


def normalized(rows: DataFrame, most: int = 16) -> DataFrame:
    """Loose diagram rows (diagram, ord, id, title, kind) with defaults, the first of each id, up to a cap a diagram."""
    d = rows.withColumns({"title": F.coalesce(F.nullif(F.trim("title"), F.lit("")), "id"), "kind": F.coalesce("kind",
        F.lit("module"))}).where("id is not null")
    first = d.withColumn("_rn", F.row_number().over(Window.partitionBy("diagram", "id").orderBy("ord"))).where(
        "_rn = 1").drop("_rn")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("diagram").orderBy("ord",
        "id"))).where(F.col("place") <= most)


def problems(messages: DataFrame, participants: DataFrame, least: float = 0.7) -> DataFrame:
    """What is wrong with diagrams: unknown ends, messages without evidence, too little of them proven."""
    known = participants.select("diagram", "participant")
    ends = messages.select("diagram", F.explode(F.array("sender", "receiver")).alias("participant"))
    unknown = ends.join(known, ["diagram", "participant"], "left_anti").groupBy("diagram").agg(F.count("*").alias(
        "n")).select("diagram", F.lit("unknown-end").alias("problem"), "n")
    bare = messages.where("evidence is null").groupBy("diagram").agg(F.count("*").alias("n")).select("diagram", F.lit(
        "no-evidence").alias("problem"), "n")
    thin = messages.groupBy("diagram").agg(F.count("*").alias("n"), F.count("evidence").alias("e")).where(F.col(
        "e") / F.col("n") < least).select("diagram", F.lit("low-coverage").alias("problem"), "n")
    return unknown.unionByName(bare).unionByName(thin)


def fill(items: DataFrame, budget: int, by: str = "owner", quota: int | None = None) -> DataFrame:
    """Greedy choice per owner under a budget of characters, and at most quota items a kind: mandatory items first, then by rank and id; an item that does not fit is skipped and
    the next one tried, which no running sum expresses.  items(owner, id, kind, size, rank, mandatory); an owner's items are met in one group."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        left, counts, out = budget, {}, []
        for r in pdf.sort_values(["mandatory", "rank", "id"], ascending=[False, True, True]).itertuples():
            if r.mandatory or r.size <= left and (quota is None or counts.get(r.kind, 0) < quota):
                left -= r.size
                counts[r.kind] = counts.get(r.kind, 0) + 1
                out.append((getattr(r, by), r.id, len(out) + 1, left))
        return pd.DataFrame(out, columns=[by, "id", "place", "left"])

    return items.groupBy(by).applyInPandas(choose,
        f"{by} {items.schema[by].dataType.simpleString()}, id {items.schema['id'].dataType.simpleString()}, place long, left long")


def contributions(parts: DataFrame) -> DataFrame:
    """parts(owner, part, size): the largest part of each, and the total."""
    return parts.groupBy("owner").agg(F.max_by("part", F.struct("size", "part")).alias("largest"), F.sum("size").alias(
        "total"))


def bounded_log(events: DataFrame, by: str, order: str, most_bytes: int, most_events: int) -> DataFrame:
    """Events in order until one more would go beyond a size or a number; the rest is dropped."""
    w = Window.partitionBy(by).orderBy(order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    d = events.withColumns({"bytes": F.sum(F.octet_length("text")).over(run), "place": F.row_number().over(w)})
    return d.where((F.col("bytes") <= most_bytes) & (F.col("place") <= most_events))


def serialized(events: DataFrame, by: str, order: str) -> DataFrame:
    """One text an owner: its events' lines in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: x["line"])
    return events.groupBy(by).agg(F.array_join(lines, "\n").alias("text"), F.count("*").alias("n"))
