"""Operators that SQL does not express, and assembly operators, against plain code."""

import random

from lodestrata.operators import assembly as A
from lodestrata.operators import graph, sequences, views
from lodestrata.plans import assembly_queries, graph_queries, registry, scalar_queries  # noqa: F401
from lodestrata.sources import bridge as B


def plain_rolled_up(paths, own):
    """Roles of folders, from a tree walked depth first."""
    tree: dict = {}
    for p in sorted(set(paths)):
        node = tree
        for part in p.split("/"):
            node = node.setdefault(part, {})
    out = {}

    def walk(name, node):
        """The role of a node, and the different roles below it."""
        below = []
        for part, child in node.items():
            role, more = walk(f"{name}/{part}" if name else part, child)
            for x in ([role] if role else []) + more:
                if x not in below:
                    below.append(x)
        below = below[:4]
        role = own.get(name)
        if node and role is None and below:
            role = below[0] if len(
                below) == 1 else f"{below[0].removesuffix('.')}, plus {len(below) - 1} related responsibilities."
        if node and role:
            out[name] = role
        return role, below

    walk("", tree)
    out.pop("", None)
    return out


def test_roles_roll_up(spark):
    rng = random.Random(4)
    paths = ["/".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + f"/f{i}.ts" for i in range(60)]
    own = {p: f"Does {rng.randint(0, 5)}." for p in paths if rng.random() < 0.6} | {"a/b": "Own role."}
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    roles = spark.createDataFrame(list(own.items()), "path string, role string")
    got = {r["path"]: r["role"] for r in A.rolled_up(files, roles).collect()}
    assert got == plain_rolled_up(paths, own)
    assert A.rolled_up(files.limit(0), roles).count() == 0


def test_branches(spark):
    none: list = []
    assigned = [
        ("x", 1, none, "A"), ("x", 3, ["if1:0"], "B"), ("x", 4, ["if1:1"], "C"), ("x", 6, ["if2:0"], "A"),
        ("y", 2, none, "A"), ("y", 3, ["if1:0"], "A"),
        ("z", 9, none, "A"),
    ]
    calls = [("c1", "x", 2, none), ("c2", "x", 3, ["if1:0"]), ("c3", "x", 4, ["if1:1"]), ("c4", "x", 5, none), ("c5",
        "x", 7, ["if2:0"]), ("c6", "y", 5, none), ("c7", "z", 5, none), ("c8", "x", 7, ["if2:1"])]
    a = spark.createDataFrame(assigned, "name string, at int, path array<string>, identity string")
    c = spark.createDataFrame(calls, "id string, name string, at int, path array<string>")
    got = {r["id"]: (r["state"], r["identity"]) for r in A.branch_binding(a, c).collect()}
    assert got == {
        "c1": ("bound", "A"), "c2": ("bound", "B"), "c3": ("bound", "C"), "c4": ("ambiguous", None),
        "c5": ("bound", "A"), "c6": ("bound", "A"), "c7": ("unresolved", None), "c8": ("ambiguous", None),
    }


def test_exports_end_at_cycles(spark):
    exports = [("a", "f", "b", "g"), ("b", "g", None, None), ("c", "f", "d", "f"), ("d", "f", "c", "f"), ("e", "f",
        None, None), ("e", "f", "a", "f")]
    e = spark.createDataFrame(exports, "module string, name string, to_module string, to_name string")
    u = spark.createDataFrame([(1, "a", "f"), (2, "c", "f"), (3, "e", "f"), (4, "b", "g"), (5, "x", "f")],
        "id int, module string, name string")
    got = {r["id"]: (r["declared_in"], r["declared_as"]) for r in A.through_exports(u, e).collect()}
    assert got == {1: ("b", "g"), 2: (None, None), 3: (None, None), 4: ("b", "g"), 5: (None, None)}


def test_fill_skips_what_does_not_fit(spark, small):
    f = B.files(spark, small)
    rows = [(r["module"], r["path"], r["scope"], r["size"], r["doc_id"] % 3, r["doc_id"] % 40 == 0)
        for r in f.collect()]
    want = set()
    for owner in {r[0] for r in rows}:
        left, kinds, place = 12_000, {}, 0
        for _, path, kind, size, _, must in sorted((r for r in rows if r[0] == owner), key=lambda r: (not r[5], r[4],
            r[1])):
            if must or size <= left and kinds.get(kind, 0) < 5:
                left, place = left - size, place + 1
                kinds[kind] = kinds.get(kind, 0) + 1
                want.add((owner, path, place, left))
    got = registry.QUERIES["t4_budget_fill"](spark, small)
    assert {tuple(r) for r in got.select("owner", "id", "place", "left").collect()} == want
    assert sequences.fill(spark.createDataFrame([], "owner string, id string, kind string, size long, rank int, "
        "mandatory boolean"), 10).count() == 0


def test_frontier_hides_most_first(spark):
    paths = [("a", "a/1")] * 5 + [("a", "a/2")] * 3 + [("b", "b/1")] * 7 + [("c",)]
    df = spark.createDataFrame([(str(i), list(p)) for i, p in enumerate(paths)], "id string, group_path array<string>")
    assert [tuple(r) for r in views.frontier(df, 4).collect()] == [(1, "a", 9), (2, "b", 3)]


def test_set_hash_is_of_the_set(spark):
    texts = [f"t{i}" for i in range(500)]
    one = lambda x, n: spark.createDataFrame([(t,) for t in x], "t string").repartition(n).agg(graph.set_hash("t")
        .alias("h")).first()["h"]
    assert one(texts, 3) == one(texts[::-1], 7) != one(texts[1:], 3)


def test_clusters_take_each_file_once(spark, small):
    files, _ = graph_queries._code(spark, small)
    got = registry.QUERIES["g7_clusters"](spark, small).collect()
    assert sorted(r["file"] for r in got) == sorted(r["file"] for r in files.collect())
    shown = registry.QUERIES["a11_categories"](spark, small).collect()
    members: dict = {}
    for r in got:
        members[r["cluster"]] = members.get(r["cluster"], 0) + 1
    assert {r["cluster"]: r["files"] for r in shown} == members
    findings = registry.QUERIES["a33_diagnostics"](spark, small).collect()
    unknown = {r["cluster"]: r["files"] for r in shown if r["category"] == "unknown"}
    assert {r["subject"]: r["n"] for r in findings if r["code"] == "unknown-files"} == unknown
    assert {r["subject"] for r in findings if r["code"] == "ambiguous-ownership"} == {r["file"] for r in got if r[
        "ambiguous"]}
