"""Graph operators: bounded loops over DataFrames.

Tables: edges(source, target).  Each round is written as a table in the shared folder, which ends its lineage and
survives a lost executor."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where that is unset, a folder of our own if Spark runs on this machine alone; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "lodestrata-rounds")
    return found.rstrip("/")


def set_hash(values: Column) -> Column:
    """An aggregate: one hash of a set of texts (each there once), whatever their order.  Four sums of parts of their SHA-256, which combine before
    the shuffle; no list is gathered."""
    digest = F.sha2(values, 256)
    parts = [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")) for i in range(4)]
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[p.cast("string") for p in parts]), 256)


def settled(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(edges: DataFrame, roots: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Nodes that edges lead to from roots(id), with the number of steps (0 for roots)."""
    edges = settled(edges.select("source", "target").distinct())
    seen = frontier = settled(roots.select("id", F.lit(0).alias("steps")).distinct())
    for step in range(1, most_rounds + 1):
        found = frontier.join(edges, frontier["id"] == edges["source"]).select(F.col("target").alias(
            "id")).distinct().join(seen, "id", "left_anti")
        frontier = settled(found.select("id", F.lit(step).alias("steps")))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if step % 8 == 0:
            seen = settled(seen)
    raise RuntimeError(f"not at an end after {most_rounds} rounds")


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Weak components: (id, component), the smallest id that can be reached without regard to direction.

    Nodes are numbered in the order of their ids first, so that the rounds join and combine numbers.  Each round takes the least label among neighbours,
    then jumps to the label's own label, which halves long chains."""
    from .dedupe import with_number

    named = settled(with_number(nodes.select("id").distinct(), ["id"], "number"))
    end = lambda name: named.select(F.col("id").alias(name), F.col("number").alias(f"{name}_number"))
    apart = edges.select("source", "target").where("source <> target").join(end("source"), "source").join(end("target"), "target").select("source_number", "target_number").distinct()
    apart = settled(apart)
    both = settled(apart.union(apart.select("target_number", "source_number")).toDF("id", "other").distinct())
    labels = settled(named.select(F.col("number").alias("id"), F.col("number").alias("component")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min(
            "component").alias("least"))
        low = labels.join(near, "id", "left").select("id", F.col("component").alias("before"), F.least("component",
            F.coalesce("least", "component")).alias("component"))
        jump = low.select(F.col("id").alias("component"), F.col("component").alias("root"))
        new = settled(low.join(jump, "component", "left").select("id", "before", F.least(F.coalesce("root",
            "component"), "component").alias("component")))
        changed = not new.where("component <> before").isEmpty()
        labels = new.select("id", "component")
        if not changed:
            own = labels.withColumnsRenamed({"id": "number", "component": "least"}).join(named, "number").select("id", "least")
            return own.join(named.select(F.col("number").alias("least"), F.col("id").alias("component")), "least").select("id", "component")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths of edges(source, target) through nodes that one edge leads to and one leads on from, by pointer doubling.

    Inner nodes: (id, first, last, offset), where the path comes from, where it leads to, and how many steps after first the node stands; a ring of inner nodes
    alone has no ends: its nodes have first and last null, and ring, its smallest id.  And the edges with each path as one: (source, target, length)."""
    edges = settled(edges.select("source", "target").where("source <> target").distinct())
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_in"), F.min("source").alias("from"))
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_out"), F.min("target").alias("to"))
    inner = settled(into.where("n_in = 1").join(out.where("n_out = 1"), "id").select("id", "from", "to"))
    # back and ahead say how far a node has looked either way, and where that ends: at the first node that is no inner one, or not yet
    own = inner.select(F.col("id").alias("at"), F.lit(True).alias("goes_on"))
    step = lambda df, at, flag: df.join(own.select(F.col("at").alias(at), F.col("goes_on").alias(flag)), at, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    state = step(step(inner.select("id", F.col("from").alias("back"), F.lit(1).cast("long").alias("offset"), F.col("to").alias("ahead"), F.col("id").alias("least")), "back", "more_back"), "ahead",
        "more_ahead")
    state, total, reach = settled(state), inner.count(), 1
    while reach <= 2 * total and not state.where("more_back or more_ahead").isEmpty():
        far = state.select(F.col("id").alias("at"), F.col("back").alias("far_back"), F.col("offset").alias("far_offset"), F.col("more_back").alias("far_more_back"), F.col("ahead").alias("far_ahead"),
            F.col("more_ahead").alias("far_more_ahead"), F.col("least").alias("far_least"))
        b, f = far.alias("b"), far.alias("f")
        both = state.alias("s").join(b, F.when(F.col("s.more_back"), F.col("s.back")) == F.col("b.at"), "left").join(f, F.when(F.col("s.more_ahead"), F.col("s.ahead")) == F.col("f.at"), "left")
        new = lambda side, c: F.when(F.col(f"s.more_{side}"), F.col(f"{'b' if side == 'back' else 'f'}.far_{c}")).otherwise(F.col(f"s.{c}"))
        state = settled(both.select("s.id", new("back", "back").alias("back"), (F.col("s.offset") + F.when(F.col("s.more_back"), F.col("b.far_offset")).otherwise(0)).alias("offset"), new("ahead",
            "ahead").alias("ahead"), F.least("s.least", F.coalesce("b.far_least", "s.least"), F.coalesce("f.far_least", "s.least")).alias("least"), new("back", "more_back").alias("more_back"), new(
            "ahead", "more_ahead").alias("more_ahead")))
        reach *= 2
    ring = F.col("more_back") | F.col("more_ahead")
    found = settled(state.select("id", F.when(~ring, F.col("back")).alias("first"), F.when(~ring, F.col("ahead")).alias("last"), F.when(~ring, F.col("offset")).alias("offset"), F.when(ring, F.col(
        "least")).alias("ring")))
    inside = found.select(F.col("id").alias("source"))
    plain = edges.join(inside, "source", "left_anti").join(inside.select(F.col("source").alias("target")), "target", "left_anti").select("source", "target", F.lit(1).cast("long").alias("length"))
    # the inner node that stands before a path's last node tells its length
    ends = found.where("ring is null").join(edges.select(F.col("source").alias("id"), "target"), "id").where("target = last").select(F.col("first").alias("source"), F.col("last").alias("target"), (F.col(
        "offset") + 1).alias("length"))
    return found, plain.unionByName(ends)


def strong_components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Strong components: (id, component, cyclic).  component is the smallest id in it.

    Long paths become one edge first (their inner nodes are with both ends or alone).  Then forward-backward colouring: every node takes the smallest id that
    reaches it; within a colour, whatever reaches that id back is its component.  Nodes found leave, as do sources and sinks before each round, and the rest
    goes on.  Nodes that are left after most_rounds raise an error."""
    edges = settled(edges.select("source", "target").distinct())
    nodes = settled(nodes.select("id").distinct())
    inner, short = chains(edges)
    outer = settled(nodes.join(inner.select("id"), "id", "left_anti"))
    parts = _coloured(outer, short.select("source", "target").distinct(), most_rounds)
    # a path's inner nodes are in its ends' component if they have one in common (or one end)
    a, b = parts.select(F.col("id").alias("first"), F.col("component").alias("a")), parts.select(F.col("id").alias("last"), F.col("component").alias("b"))
    placed = inner.join(a, "first", "left").join(b, "last", "left").select("id", F.coalesce("ring", F.when(F.col("a") == F.col("b"), F.col("a")), "id").alias("component"))
    found = settled(parts.unionByName(placed))
    loops = edges.where("source = target").select(F.col("source").alias("id"), F.lit(True).alias("loop"))
    least = found.join(found.groupBy("component").agg(F.min("id").alias("name"), F.count("*").alias("n")), "component")
    return least.join(loops, "id", "left").select("id", F.col("name").alias("component"), ((F.col("n") > 1)
        | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def _coloured(nodes: DataFrame, edges: DataFrame, most_rounds: int) -> DataFrame:
    """(id, component) by forward-backward colouring."""
    left, found = nodes, []
    rest = settled(edges.where("source <> target"))
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        # sources and sinks are components by themselves
        busy = settled(rest.select(F.col("source").alias("id")).distinct().join(rest.select(F.col("target").alias("id")).distinct(), "id", "left_semi"))
        alone = settled(left.join(busy, "id", "left_anti"))
        if not alone.isEmpty():
            found.append(alone.select("id", F.col("id").alias("component")))
            left = settled(left.join(busy, "id", "left_semi"))
            rest = settled(rest.join(left.withColumnRenamed("id", "source"), "source", "left_semi").join(left.withColumnRenamed("id", "target"), "target", "left_semi"))
            continue
        color = settled(left.select("id", F.col("id").alias("color")))
        while True:
            near = rest.join(color.select(F.col("id").alias("source"), "color"), "source").groupBy(F.col("target")
                .alias("id")).agg(F.min("color").alias("least"))
            new = settled(color.join(near, "id", "left").select("id", F.col("color").alias("before"), F.least("color",
                F.coalesce("least", "color")).alias("color")))
            done = new.where("color <> before").isEmpty()
            color = new.select("id", "color")
            if done:
                break
        same = rest.join(color.select(F.col("id").alias("source"), "color"), "source").join(color.select(F.col("id")
            .alias("target"), F.col("color").alias("c2")), "target").where("color = c2").select("source", "target",
            "color")
        same = settled(same)
        inside = frontier = settled(color.where("id = color").select("id", "color"))
        while True:
            back = same.join(frontier.select(F.col("id").alias("target"), F.col("color").alias("c")), "target").where(
                "c = color").select(F.col("source").alias("id"), "color").distinct().join(inside.select("id"), "id",
                "left_anti")
            frontier = settled(back)
            if frontier.isEmpty():
                break
            inside = settled(inside.unionByName(frontier))
        found.append(inside.select("id", F.col("color").alias("component")))
        left = settled(left.join(inside.select("id"), "id", "left_anti"))
        rest = settled(rest.join(left.withColumnRenamed("id", "source"), "source", "left_semi")
            .join(left.withColumnRenamed("id", "target"), "target", "left_semi"))
    if not left.isEmpty():
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    if not found:
        return nodes.select("id", F.col("id").alias("component"))
    return settled(reduce(lambda a, b: a.unionByName(b), found))


def condensed(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges between components, once each, without loops."""
    a, b = parts.select(F.col("id").alias("source"), F.col("component").alias("a")), parts.select(F.col("id").alias(
        "target"), F.col("component").alias("b"))
    return edges.join(a, "source").join(b, "target").where("a <> b").select(F.col("a").alias("source"), F.col("b")
        .alias("target")).distinct()


def layers(nodes: DataFrame, edges: DataFrame, most_rounds: int = 10_000) -> DataFrame:
    """Longest path to each node of an acyclic graph (id, depth), sources at 0.  A cycle raises.

    Long paths become one edge with their length first, so rounds are as many as a path has branch points, not nodes; an inner node stands its offset below
    where its path comes from."""
    edges = settled(edges.select("source", "target").distinct())
    if not edges.where("source = target").isEmpty():
        raise RuntimeError("the graph has a cycle")
    nodes = settled(nodes.select("id").distinct())
    inner, short = chains(edges)
    if not inner.where("ring is not null").isEmpty():
        raise RuntimeError("the graph has a cycle")
    short = settled(short)
    depth = settled(nodes.join(inner.select("id"), "id", "left_anti").select("id", F.lit(0).cast("long").alias("depth")))
    most = depth.count()
    for _ in range(min(most_rounds, most + 1)):
        below = short.join(depth.select(F.col("id").alias("source"), "depth"), "source").groupBy(F.col("target").alias(
            "id")).agg(F.max(F.col("depth") + F.col("length")).alias("new"))
        now = settled(depth.join(below, "id", "left").select("id", F.col("depth").alias("before"), F.greatest("depth",
            F.coalesce("new", F.lit(0))).alias("depth")))
        changed = not now.where("depth <> before").isEmpty()
        depth = now.select("id", "depth")
        if not changed:
            along = inner.join(depth.select(F.col("id").alias("first"), F.col("depth").alias("start")), "first").select("id", (F.col("start") + F.col("offset")).alias("depth"))
            return depth.unionByName(along).select("id", F.col("depth").cast("int").alias("depth"))
    raise RuntimeError("the graph has a cycle, or a path longer than the rounds")


def fingerprint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One hash of a graph's topology."""
    keys = nodes.select(F.concat(F.lit("n:"), "id").alias("k")).unionByName(edges.select(F.concat(F.lit("e:"), "source",
        F.lit(">"), "target").alias("k"))).distinct()
    return keys.agg(set_hash(F.col("k")).alias("fingerprint"))


def tree(paths: DataFrame) -> DataFrame:
    """All files and folders of paths(path): path, parent, name, depth, type."""
    from ..functions import scalars as X

    above = paths.select(F.explode(X.folders(F.col("path"))).alias("path"), F.lit("folder").alias("type")).distinct()
    rows = paths.select("path", F.lit("file").alias("type")).distinct().unionByName(above)
    return rows.select("path", X.parent(F.col("path")).alias("parent"), X.file_name(F.col("path")).alias("name"),
        F.size(F.split("path", "/")).alias("depth"), "type")


def descendants(files: DataFrame) -> DataFrame:
    """Files and bytes under each folder of files(path, size)."""
    from ..functions import scalars as X

    return files.select(F.explode(X.folders(F.col("path"))).alias("folder"), "size").groupBy("folder").agg(F.count("*")
        .alias("files"), F.sum("size").alias("bytes"))


def common_directory(files: DataFrame) -> DataFrame:
    """The deepest folder that all files of a module (module, path) share; empty if none."""
    from ..functions import scalars as X

    counts = files.groupBy("module").agg(F.count("*").alias("n"))
    over = files.select("module", F.explode(X.folders(F.col("path"))).alias("folder")).groupBy("module",
        "folder").agg(F.count("*").alias("c"))
    deepest = over.join(counts, "module").where("c = n").groupBy("module").agg(F.max_by("folder", F.length("folder"))
        .alias("folder"))
    return counts.join(deepest, "module", "left").select("module", F.coalesce("folder", F.lit("")).alias("folder"))


def ranked_ports(ports: DataFrame) -> DataFrame:
    """Places of ports(node, side, edge) on their side, reversed at the left and the bottom, with offsets in percent (one shared place beyond six)."""
    side = Window.partitionBy("node", "side")
    place = F.when(F.col("side").isin("left", "bottom"), F.row_number().over(side.orderBy(F.desc(
        "edge")))).otherwise(F.row_number().over(side.orderBy("edge")))
    counted = ports.withColumn("n", F.count("*").over(side)).withColumn("place", place)
    return counted.withColumn("offset", F.when(F.col("n") > 6, F.lit(50.0)).otherwise(F.col("place") * (100.0 / (F.col(
        "n") + 1))))
