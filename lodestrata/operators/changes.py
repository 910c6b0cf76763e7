"""Change data: deltas of snapshots, reconciliation of edits with a new base, states and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scan_delta(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Status of each path of two scans (path, hash): added, modified, deleted or unchanged."""
    p, c = previous.select("path", F.col("hash").alias("old")), current.select("path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), F.lit("added")).when(F.col("new").isNull(), F.lit("deleted")).when(F.col(
        "old") != F.col("new"), F.lit("modified")).otherwise(F.lit("unchanged"))
    return p.join(c, "path", "full").select("path", status.alias("status"))


def changed_fields(previous: DataFrame, current: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per key added, deleted or modified, with the names of the fields whose current value differs; a field that is absent now is not reported."""
    old, new = (df.select(key, F.lit(True).alias(f"has_{s}"), *[F.col(f).alias(f"{f}_{s}") for f in fields]) for df,
        s in ((previous, "old"), (current, "new")))
    both = old.join(new, key, "full")
    differs = F.array_compact(F.array(*[F.when(F.col(f"{f}_new").isNotNull() & ~F.col(f"{f}_old").eqNullSafe(F.col(
        f"{f}_new")), F.lit(f)) for f in fields]))
    status = F.when(F.col("has_old").isNull(), F.lit("added")).when(F.col("has_new").isNull(), F.lit(
        "deleted")).when(F.size(differs) > 0, F.lit("modified"))
    return both.select(key, status.alias("status"), F.when(status == "modified", differs).otherwise(F.array().cast(
        "array<string>")).alias("fields")).where("status is not null")


def normalized(snapshot: DataFrame, texts: list[str], lists: list[str], key: str, ordinal: str) -> DataFrame:
    """Texts trimmed, lists sorted without repeats, the last row of each key."""
    rows = snapshot.withColumns({**{c: F.trim(c) for c in texts}, **{c: F.array_sort(F.array_distinct(c))
        for c in lists}})
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ordinal)))
    return rows.withColumn("_rn", last).where("_rn = 1").drop("_rn")


def acknowledged(base: DataFrame, sent: DataFrame, ids: DataFrame | None, key: str = "id") -> DataFrame:
    """The base with the rows that were sent in place of its own: all, or those in ids; rows that sent lacks leave within that scope."""
    scope = ids.select(key).distinct() if ids is not None else base.select(key).union(sent.select(key)).distinct()
    return base.join(scope, key, "left_anti").unionByName(sent.join(scope, key, "left_semi").select(*base.columns))


def user_state(generated: DataFrame, edited: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """What a user changed: rows hidden, rows added, and for edited rows the new values of the fields that differ."""
    g, e = (df.select(key, F.lit(True).alias(f"has_{s}"), *[F.col(f).alias(f"{f}_{s}") for f in fields]) for df,
        s in ((generated, "g"), (edited, "e")))
    both = g.join(e, key, "full")
    new = [F.when(~F.col(f"{f}_g").eqNullSafe(F.col(f"{f}_e")), F.col(f"{f}_e")).alias(f) for f in fields]
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"{f}_g").eqNullSafe(F.col(f"{f}_e"))
    state = F.when(F.col("has_e").isNull(), F.lit("hidden")).when(F.col("has_g").isNull(), F.lit(
        "manual")).when(differs, F.lit("edited"))
    return both.select(key, state.alias("state"), *new).where("state is not null")


def reconciled(old: DataFrame, user: DataFrame, new: DataFrame, key: str, field: str) -> DataFrame:
    """Three-way merge of (key, field): the user's value wins where only the user changed it, the new base's where only that changed; both changed to
    different values is a conflict (the user's value stays); a key that the new base lacks is an orphan if the user changed it, else it goes; a key that the user removed
    stays removed (tombstone)."""
    o, u, n = (df.select(key, F.lit(True).alias(f"in_{s}"), F.col(field).alias(s)) for df, s in ((old, "o"), (user,
        "u"), (new, "n")))
    all_ = o.join(u, key, "full").join(n, key, "full")
    edited, moved = ~F.col("u").eqNullSafe(F.col("o")), ~F.col("n").eqNullSafe(F.col("o"))
    has = lambda s: F.col(f"in_{s}").isNotNull()
    outcome = (
        F.when(has("o") & ~has("u"), F.when(has("n"), F.lit("tombstone")))
        .when(~has("o") & has("u"), F.when(has("n"), F.when(F.col("u").eqNullSafe(F.col("n")), F.lit("kept"))
            .otherwise(F.lit("conflict"))).otherwise(F.lit("manual")))
        .when(~has("o"), F.lit("added"))
        .when(~has("n"), F.when(edited, F.lit("orphan")))
        .when(edited & moved & ~F.col("u").eqNullSafe(F.col("n")), F.lit("conflict"))
        .when(edited, F.lit("user"))
        .when(moved, F.lit("updated"))
        .otherwise(F.lit("kept"))
    )
    value = F.when(outcome.isin("added", "updated"), F.col("n")).when(outcome == "tombstone",
        F.lit(None)).otherwise(F.col("u"))
    return all_.select(key, outcome.alias("outcome"), value.alias("value")).where("outcome is not null")


def row_fingerprint(columns: list[str]) -> Column:
    """A hash of some columns in this order; nulls and the places of values count."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def invalidated(assessed: DataFrame, current: DataFrame) -> DataFrame:
    """Assessments (id, fingerprint) whose input has another fingerprint by now, or is gone."""
    now = current.select("id", F.col("fingerprint").alias("now"))
    return assessed.join(now, "id", "left").where(~F.col("now").eqNullSafe(F.col("fingerprint"))).select("id", F.col(
        "now").isNull().alias("gone"))


def with_override(risk: DataFrame, overrides: DataFrame) -> DataFrame:
    """risk(id, level) with the user's level where overrides(id, level, reason) gives one with a reason; whether the system's level changed since."""
    o = overrides.where(F.trim("reason") != "").select("id", F.col("level").alias("o_level"), F.col("level_then"))
    joined = risk.join(o, "id", "left")
    return joined.select("id", F.col("level").alias("system_level"), F.coalesce("o_level", "level").alias(
        "effective_level"), F.when(F.col("o_level").isNotNull(), ~F.col("level_then").eqNullSafe(F.col("level"))).alias(
        "changed"))


def corrected(edges: DataFrame, patches: DataFrame) -> DataFrame:
    """Edges with corrected ends or relation: those lose their evidence and become inferred; a correction into a loop is refused."""
    p = patches.select("id", F.col("source").alias("ps"), F.col("target").alias("pt"), F.col("relation").alias("pr"))
    j = edges.join(p, "id", "left").withColumns({"ns": F.coalesce("ps", "source"), "nt": F.coalesce("pt", "target"),
        "nr": F.coalesce("pr", "relation")})
    refused = F.col("ns") == F.col("nt")
    moved = ~refused & ((F.col("ns") != F.col("source")) | (F.col("nt") != F.col("target")) | (F.col("nr") != F.col(
        "relation")))
    return j.select("id", F.when(refused, F.col("source")).otherwise(F.col("ns")).alias("source"), F.when(refused,
        F.col("target")).otherwise(F.col("nt")).alias("target"), F.when(refused, F.col("relation")).otherwise(F.col(
        "nr")).alias("relation"), F.when(moved, F.lit("inferred")).otherwise(F.col("confidence")).alias("confidence"),
        moved.alias("corrected"))


def to_reuse(previous: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts of the previous run (path, hash, ...) that still hold, and the rows of current (path, hash, ...) that must be extracted anew."""
    return previous.join(current.select("path", "hash"), ["path", "hash"], "left_semi"), current.join(previous.select(
        "path", "hash"), ["path", "hash"], "left_anti")


def review_state(reviews: DataFrame) -> DataFrame:
    """reviews(id, running, reviewed_input, current_input, adopted): reviewing while running, stale if the input changed since, reviewed if adopted, else local."""
    state = F.when(F.col("running"), F.lit("reviewing")).when(F.col("reviewed_input").isNull(), F.lit(
        "local")).when(F.col("reviewed_input") != F.col("current_input"), F.lit("stale")).when(F.col("adopted"), F.lit(
        "reviewed")).otherwise(F.lit("local"))
    return reviews.withColumn("state", state)


def in_time(responses: DataFrame) -> DataFrame:
    """responses(id, started, completed, timeout): a response that came by its deadline counts, whenever it is looked at."""
    deadline = F.col("started") + F.make_dt_interval(secs=F.col("timeout"))
    return responses.withColumn("outcome", F.when(F.col("completed").isNull(), F.lit("pending")).when(F.col(
        "completed") <= deadline, F.lit("completed")).otherwise(F.lit("timeout")))


def resolve_pending(items: DataFrame, choices: DataFrame) -> DataFrame:
    """Pending items after choices(id, action, to): kept, discarded or bound to another target, if exactly one choice names an item and no two items get one target."""
    one = choices.groupBy("id").agg(F.count("*").alias("n"), F.min("action").alias("action"), F.min("to").alias(
        "to")).where("n = 1").drop("n")
    clash = one.where("action = 'rebind'").groupBy("to").agg(F.count("*").alias("uses"))
    j = items.join(one, "id", "left").join(clash, "to", "left")
    state = F.when(F.col("action") == "discard", F.lit("discarded")).when(F.col("action") == "keep", F.lit(
        "kept")).when((F.col("action") == "rebind") & (F.col("uses") == 1), F.lit("bound")).otherwise(F.lit("pending"))
    return j.select("id", state.alias("state"), F.when(state == "bound", F.col("to")).alias("bound_to"))


def adoption(runs: DataFrame) -> DataFrame:
    """runs(id, ok, mode, base, now, valid): what becomes of a run's output."""
    return runs.withColumn("adoption", F.when(~F.col("ok"), F.lit("not-applicable")).when(F.col("base") != F.col("now"),
        F.lit("stale")).when(~F.col("valid"), F.lit("rejected")).when(F.col("mode") == "manual", F.lit("pending"))
        .otherwise(F.lit("applied")))


def rollback(changed: DataFrame, checkpoint: DataFrame, untracked: DataFrame, untracked_then: DataFrame) -> DataFrame:
    """Paths that a rollback restores (changed now or at the checkpoint) and deletes (untracked now but not then)."""
    restore = changed.select("path").union(checkpoint.select("path")).distinct().withColumn("action", F.lit("restore"))
    remove = untracked.select("path").join(untracked_then.select("path"), "path", "left_anti").distinct().withColumn(
        "action", F.lit("delete"))
    return restore.unionByName(remove)


def diff_counts(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows added, removed and modified between two tables."""
    a, b = left.select(key, row_fingerprint(columns).alias("a")), right.select(key, row_fingerprint(columns).alias("b"))
    return a.join(b, key, "full").agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull())
        .alias("removed"), F.count_if(F.col("a") != F.col("b")).alias("modified"))
