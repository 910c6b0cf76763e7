"""Strong components and layers on long paths, rings and random graphs, against plain code; HTTP routes and representative files."""

import random

import pytest

from lodestrata.operators import extraction, graph


def plain_components(ids, edges):
    to = {i: [] for i in ids}
    for a, b in edges:
        to[a].append(b)

    def reach(i):
        seen, stack = {i}, [i]
        while stack:
            for n in to[stack.pop()]:
                if n not in seen:
                    seen.add(n)
                    stack.append(n)
        return seen

    reached = {i: reach(i) for i in ids}
    return {i: (min(part := [j for j in reached[i] if i in reached[j]]), len(part) > 1 or (i, i) in edges) for i in ids}


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(60)]
    edges = {(rng.choice(ids), rng.choice(ids)) for _ in range(35)}
    ring = [f"r{i}" for i in range(5)]
    edges |= set(zip(ring, ring[1:] + ring[:1])) | {("n000", "p0"), ("p0", "p1"), ("p1", "p2"), ("p2", "n000"), ("s", "s")}
    ids += [*ring, "p0", "p1", "p2", "s"]
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    table = spark.createDataFrame(sorted(edges), "source string, target string")
    found = {r["id"]: (r["component"], r["cyclic"]) for r in graph.strong_components(nodes, table).collect()}
    assert found == plain_components(ids, edges)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n, written = 100_000, []
    kept = graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: written.append(1) or kept(df))
    nodes = spark.range(n).selectExpr("id")
    edges = spark.range(n - 1).selectExpr("id AS source", "id + 1 AS target")
    found = graph.layers(nodes, edges)
    assert found.where("depth <> id").isEmpty() and found.count() == n
    assert len(written) < 40
    written.clear()
    back = edges.unionByName(spark.createDataFrame([(n - 1, 0)], "source long, target long"))
    parts = graph.strong_components(nodes, back)
    assert parts.where("component <> 0 or not cyclic").isEmpty() and parts.count() == n and len(written) < 40
    assert graph.strong_components(nodes, edges).where("component <> id or cyclic").isEmpty()


def test_layers_of_random_graphs(spark):
    rng = random.Random(9)
    edges = {(a, b) for a, b in ((rng.randrange(50), rng.randrange(50)) for _ in range(60)) if a < b} | {(i, i + 1) for i in range(60, 80)} | {(3, 60), (80, 90)}
    ids = sorted({x for e in edges for x in e} | {99})
    depth = {i: 0 for i in ids}
    for i in ids:
        for a, b in edges:
            if a == i:
                depth[b] = max(depth[b], depth[i] + 1)
    nodes = spark.createDataFrame([(i,) for i in ids], "id long")
    found = graph.layers(nodes, spark.createDataFrame(sorted(edges), "source long, target long"))
    assert {r["id"]: r["depth"] for r in found.collect()} == depth
    for wrong in ([(1, 2), (2, 1)], [(1, 1)], [(1, 2), (2, 3), (3, 1), (0, 1), (0, 2)]):
        with pytest.raises(RuntimeError):
            graph.layers(nodes, spark.createDataFrame(wrong, "source long, target long"))


def test_rounds_that_run_out_are_an_error(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id long")
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 3), (3, 2), (1, 2), (0, 3)], "source long, target long")
    with pytest.raises(RuntimeError):
        graph.strong_components(nodes, edges, most_rounds=1)


def test_spring_routes(spark):
    text = "@GetMapping(\"/a\") @RequestMapping(value = \"/b\") @postmapping('/c') @Mapping(\"/d\")"
    rows = extraction.endpoints(spark.createDataFrame([("X.java", text)], "path string, content string")).where("kind = 'route'").collect()
    assert {(r["method"], r["normal"]) for r in rows} == {("GET", "/a"), ("UNKNOWN", "/b"), ("POST", "/c")}


def test_representative_files_by_facts(spark):
    rows = [("src/main.ts", 0, 0, 0, 0), ("src/order-service.ts", 2, 1, 1, 1), ("tests/main.test.ts", 9, 0, 0, 0), ("a/plain.ts", 10, 0, None, 3), ("a/mainly.ts", 0, 0, 0, 0)]
    files = spark.createDataFrame(rows, "path string, n_symbols int, n_calls int, n_external int, n_imports int")
    assert [(r["path"], r["points"]) for r in extraction.representative(files, 4).collect()] == [("src/main.ts", 40), ("src/order-service.ts", 39), ("a/plain.ts", 33), ("tests/main.test.ts", 7)]
