"""Views of a property graph: filters, projections, induced and collapsed graphs.

Tables: nodes(id, kind, node_type, category, layer, stacks, domain, files, resource_kind, origin, group_path),
edges(id, source, target, relation, confidence, origin, event_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from .dedupe import keep_first


def _node_filter(role: str, tags: list[str], domain: str) -> list[Column]:
    yes = F.lit(True)
    return [yes if role == "all" else F.col("layer") == role, F.arrays_overlap("stacks", F.array(*map(F.lit, tags)))
        if tags else yes, yes if domain == "all" else F.col("domain") == domain]


def filtered(nodes: DataFrame, role: str = "all", tags: list[str] | None = None, domain: str = "all") -> DataFrame:
    a, b, c = _node_filter(role, tags or [], domain)
    return nodes.where(a & b & c)


def why_empty(nodes: DataFrame, role: str = "all", tags: list[str] | None = None, domain: str = "all") -> DataFrame:
    """Whether a filter leaves nodes, and if not, the first part of it that nothing meets (`combination` if each is met by something)."""
    a, b, c = _node_filter(role, tags or [], domain)
    any_ = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    got = nodes.agg(F.count("*").alias("n"), any_(a & b & c).alias("all_of"), any_(a).alias("role"), any_(b).alias(
        "runtime"), any_(c).alias("domain"))
    state = F.when(F.col("n") == 0, F.lit("empty")).when(F.col("all_of"), F.lit("matches")).otherwise(F.lit(
        "no-matches"))
    cause = F.when(~F.col("role"), F.lit("role")).when(~F.col("runtime"), F.lit("runtime")).when(~F.col("domain"),
        F.lit("domain")).otherwise(F.lit("combination"))
    return got.select(state.alias("state"), F.when(state == "no-matches", cause).alias("cause"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id",
        "target"), "target", "left_semi")


def in_groups(nodes: DataFrame, edges: DataFrame, groups: list[str]) -> DataFrame:
    """Modules of some groups, all the user's own nodes, and the resources one step from a chosen module."""
    chosen = nodes.where(F.col("resource_kind").isNull() & F.arrays_overlap("group_path", F.array(*map(F.lit, groups))))
    ends = edges.select(F.col("source").alias("a"), F.col("target").alias("id")).union(edges.select(F.col("target")
        .alias("a"), F.col("source").alias("id")))
    near = ends.join(chosen.select(F.col("id").alias("a")), "a", "left_semi").select("id").distinct()
    resources = nodes.where(F.col("resource_kind").isNotNull()).join(near, "id", "left_semi")
    return chosen.unionByName(nodes.where("origin = 'manual'")).unionByName(resources).dropDuplicates(["id"])


def shown_edges(nodes: DataFrame, edges: DataFrame, mode: str = "execution", inferred: bool = False, extra: list[str]
    | None = None) -> DataFrame:
    """The edges that a view shows: confirmed calls (or dependencies), and chosen other relations; edges of tests only where asked for.  Once an id."""
    extra = extra or []
    tests = nodes.where("node_type = 'test'").select("id")
    some = nodes.where("kind = 'module' and resource_kind is null and node_type <> 'test'").limit(1).select(F.lit(True)
        .alias("has"))
    touches = edges.join(tests.select(F.col("id").alias("source"), F.lit(True).alias("t1")), "source",
        "left").join(tests.select(F.col("id").alias("target"), F.lit(True).alias("t2")), "target", "left")
    touches = touches.join(F.broadcast(some), F.lit(True), "left")  # one row at most
    clean = F.col("has").isNull() | (F.col("t1").isNull() & F.col("t2").isNull())
    own = F.coalesce(F.col("origin"), F.lit("")) != "manual"
    if mode == "execution":
        default = (F.col("relation") == "calls") & ((F.col("confidence") == "confirmed")
            | F.lit(inferred)) & own & clean
    else:
        default = (F.col("relation") == "depends_on") & own & clean
    asked = F.when(own, F.col("relation").isin(extra)).otherwise(F.lit("manual" in extra))
    allowed = clean | ((F.col("relation") == "tests") & F.lit("tests" in extra))
    picked = touches.withColumn("turn", F.when(default, F.lit(0)).when(asked & allowed, F.lit(1))).where(
        "turn is not null")
    return keep_first(picked, ["id"], ["turn", "source", "target", "relation"]).select(*edges.columns)


def event_boundaries(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of events led through a node for the event (one for each unidentified edge), and these nodes."""
    is_event = F.col("relation").isin("publishes_event", "subscribes_event")
    event = F.nullif(F.trim("event_id"), F.lit(""))
    boundary = F.when(event.isNotNull(), F.concat(F.lit("event-boundary:"), event)).otherwise(F.concat(F.lit(
        "unresolved-event:"), "id"))
    through = edges.withColumn("boundary", F.when(is_event, boundary))
    led = through.withColumns({"source": F.when(F.col("relation") == "subscribes_event", F.col("boundary"))
        .otherwise(F.col("source")), "target": F.when(F.col("relation") == "publishes_event", F.col("boundary"))
        .otherwise(F.col("target"))})
    nodes = through.where("boundary is not null").groupBy(F.col("boundary").alias("id")).agg(F.count("*").alias(
        "n_edges"), F.startswith(F.first("boundary"), F.lit("unresolved")).alias("unresolved"))
    return led.drop("boundary"), nodes


def connection_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Executable modules, and those that a confirmed, layered edge touches."""
    modules = nodes.where("kind = 'module' and resource_kind is null and node_type <> 'test'").select("id")
    layered = edges.where("coalesce(origin, '') <> 'manual' and relation not in ('depends_on', 'tests') and (relation "
        "<> 'calls' or confidence = 'confirmed')")
    ends = layered.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    joined = modules.join(ends.withColumn("linked", F.lit(True)), "id", "left")
    return joined.select("id", F.coalesce("linked", F.lit(False)).alias("connected"))


def connection_kind(nodes: DataFrame, edges: DataFrame, summary: DataFrame) -> DataFrame:
    """How each node is connected: dependency if only by dependencies, null if by other edges too, else by what its own relations are, or none."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("id"), (F.col("relation") ==
        "depends_on").alias("dep")).groupBy("id").agg(F.bool_and("dep").alias("only_deps"))
    rest = F.when(F.col("internal") > 0, F.lit("internal")).when(F.col("unresolved") > 0, F.lit(
        "unresolved")).when(F.col("external") > 0, F.lit("external")).otherwise(F.lit("none"))
    joined = nodes.select("id").join(ends, "id", "left").join(summary.withColumnRenamed("module", "id"), "id", "left")
    return joined.select("id", F.when(F.col("only_deps").isNull(), rest).when(F.col("only_deps"), F.lit("dependency"))
        .alias("connection"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges in and out of each node, and whether all of them are confirmed (null without any)."""
    ends = edges.select(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"),
        "confidence").union(edges.select(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"),
        "confidence"))
    sums = ends.groupBy("id").agg(F.sum("i").alias("upstream"), F.sum("o").alias("downstream"), F.bool_and(F.col(
        "confidence") == "confirmed").alias("confirmed"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("upstream", F.lit(0)).alias("upstream"),
        F.coalesce("downstream", F.lit(0)).alias("downstream"), "confirmed")


def search(nodes: DataFrame, text: str, most: int = 8) -> DataFrame:
    """The first few nodes, by id, with text in their title or a file's path, in any case; no resources."""
    q = F.lit(text.lower())
    hit = F.contains(F.lower("title"), q) | F.exists("files", lambda f: F.contains(F.lower(f), q))
    return nodes.where(hit & F.col("resource_kind").isNull()).orderBy("id").limit(most)


def neighbourhood(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """A node, the nodes one step from it, and the edges between."""
    own = edges.where((F.col("source") == node) | (F.col("target") == node))
    ids = own.select(F.explode(F.array("source", "target")).alias("id")).union(nodes.where(F.col("id") == node).select(
        "id")).distinct()
    return nodes.join(ids, "id", "left_semi")


def visible_rows(paths: DataFrame, open_folders: DataFrame, most: int) -> DataFrame:
    """Rows of a tree whose folders are all open, in path order, up to a cap."""
    above = paths.select("path", F.explode(X.folders(F.col("path"))).alias("folder"))
    hidden = above.join(open_folders.select("folder"), "folder", "left_anti").select("path").distinct()
    return paths.join(hidden, "path", "left_anti").orderBy("path").limit(most)


def safety(changes: DataFrame) -> DataFrame:
    """Level of a set of changed files (path, status, additions, deletions): blocked by secrets, for review when large or with many deletions."""
    # What a sensitive path looks like.
    secret = F.lower("path").rlike(r"(^|/)\.env(\.|$)|\.(pem|key|p12|pfx|crt|cer)$|secret|credential")
    large = F.col("additions") + F.col("deletions") > 500
    got = changes.agg(F.count_if(secret).alias("sensitive"), F.count_if(large).alias("large"), F.count_if(F.col(
        "status") == "deleted").alias("deleted"))
    return got.withColumn("level", F.when(F.col("sensitive") > 0, F.lit("blocked")).when((F.col("large") > 0) | (F.col(
        "deleted") > 5), F.lit("review")).otherwise(F.lit("ok")))


def entries_and_sinks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing leads to (entries), that lead nowhere (sinks), and those with a boundary file."""
    d = degrees(nodes, edges)
    boundary = nodes.select("id", F.exists("files", lambda f: X.boundary_priority(f).isNotNull()).alias("boundary"))
    return d.join(boundary, "id").select("id", ((F.col("upstream") == 0) & (F.col("downstream") > 0)).alias("entry"),
        ((F.col("downstream") == 0) & (F.col("upstream") > 0)).alias("sink"), "boundary")


def collapsed(nodes: DataFrame, edges: DataFrame, groups: list[str]) -> DataFrame:
    """Edges after some groups of nodes (the first on a node's path) became one node each: aggregates per pair and relation, confirmed if all are; inner edges go."""
    inside = F.array(*map(F.lit, groups)).cast("array<string>")
    names = nodes.select("id", F.coalesce(F.concat(F.lit("group:"), F.try_element_at(F.filter("group_path",
        lambda g: F.array_contains(inside, g)), F.lit(1))), "id").alias("shown"))
    a, b = names.select(F.col("id").alias("source"), F.col("shown").alias("a")), names.select(F.col("id").alias(
        "target"), F.col("shown").alias("b"))
    led = edges.join(a, "source").join(b, "target").where("a <> b")
    key = F.when((F.col("a") == F.col("source")) & (F.col("b") == F.col("target")), F.col("id")).otherwise(F.concat_ws(
        ":", F.lit("aggregate"), "a", "b", "relation"))
    return led.groupBy(key.alias("id"), F.col("a").alias("source"), F.col("b").alias("target"), "relation").agg(
        F.when(F.bool_and(F.col("confidence") == "confirmed"), F.lit("confirmed")).otherwise(F.lit("inferred")).alias(
            "confidence"), F.count("*").alias("n_edges"), F.min("id").alias("first_edge")
    )


def frontier(paths: DataFrame, most: int) -> DataFrame:
    """Greedily collapses the group that hides most nodes until at most `most` are shown; ties go to the smaller id.

    paths(id, group_path).  Only the counts of nodes by path are looked at (group sizes), never the nodes: they come to the driver as one row a path."""
    rows = [(tuple(r["group_path"]), r["n"]) for r in paths.groupBy("group_path").agg(F.count("*").alias("n"))
        .collect()]
    groups = sorted({g for p, _ in rows for g in p})
    done: set[str] = set()

    def shown(collapsed: set[str]) -> int:
        heads, loose = set(), 0
        for p, n in rows:
            head = next((g for g in p if g in collapsed), None)
            if head is None:
                loose += n
            else:
                heads.add(head)
        return loose + len(heads)

    now, steps = shown(done), []
    while now > most:
        more, best = min(((shown(done | {g}) - now, g) for g in groups if g not in done), default=(0, ""))
        if more >= 0:
            break
        done.add(best)
        now += more
        steps.append((len(steps) + 1, best, now))
    return paths.sparkSession.createDataFrame(steps, "step int, group string, shown long")
