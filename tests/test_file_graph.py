"""The graph between files holds every located relation; the graph loops over it against plain code."""

from lodestrata.plans import graph_queries, registry, scalar_queries  # noqa: F401
from lodestrata.sources import bridge as B

ROOT = "customer/7"


def graph_of(spark, small):
    edges = {(r["source"], r["target"]) for r in B.edges(spark, small).select("source", "target").collect()}
    ids = {r["id"] for r in B.nodes(spark, small).select("id").collect()}
    after = {i: set() for i in ids}
    for a, b in edges:
        after[a].add(b)
    return ids, edges, after


def steps_from(root, after):
    steps, now = {root: 0}, [root]
    while now:
        now = [b for a in now for b in after[a] if steps.setdefault(b, steps[a] + 1) == steps[a] + 1]
        now = list(dict.fromkeys(now))
    return steps


def parts_of(ids, after):
    reach = {i: set(steps_from(i, after)) for i in ids}
    return {i: min(j for j in reach[i] if i in reach[j]) for i in ids}


def run(spark, small, name):
    return registry.QUERIES[name](spark, small).collect()


def test_every_located_relation_is_in_an_edge(spark, small):
    located = B.relations(spark, small).where("target_file is not null or resource_id is not null").count()
    edges = B.edges(spark, small)
    assert edges.groupBy().sum("n_relations").first()[0] == located > 5000
    assert edges.count() == edges.select("id").distinct().count()
    ids, pairs, _ = graph_of(spark, small)
    assert {x for p in pairs for x in p} <= ids and len(ids) == 10 + 150 + 5


def test_reachable(spark, small):
    _, _, after = graph_of(spark, small)
    want = steps_from(ROOT, after)
    assert {r["id"]: r["steps"] for r in run(spark, small, "g1_reachable")} == want and max(want.values()) > 1


def test_components(spark, small):
    ids, edges, after = graph_of(spark, small)
    both = {i: set(after[i]) for i in ids}
    for a, b in edges:
        both[b].add(a)
    assert {r["id"]: r["component"] for r in run(spark, small, "g2_components")} == {i: min(steps_from(i, both))
        for i in ids}


def test_strong_components_condensed_and_layers(spark, small):
    ids, edges, after = graph_of(spark, small)
    parts = parts_of(ids, after)
    size = {c: sum(p == c for p in parts.values()) for c in set(parts.values())}
    assert {r["id"]: (r["component"], r["cyclic"]) for r in run(spark, small, "g3_strong_components")} == {i: (c,
        size[c] > 1 or (i, i) in edges) for i, c in parts.items()}
    flat = {(parts[a], parts[b]) for a, b in edges if parts[a] != parts[b]}
    assert {(r["source"], r["target"]) for r in run(spark, small, "g4_condensed")} == flat
    depth = dict.fromkeys(size, 0)
    for _ in size:
        for a, b in flat:
            depth[b] = max(depth[b], depth[a] + 1)
    assert {r["id"]: r["depth"] for r in run(spark, small, "g6_layers")} == depth and max(depth.values()) > 0


def test_areas_place_every_file_once(spark, small):
    ids, _, _ = graph_of(spark, small)
    n = {r["id"]: r for r in B.nodes(spark, small).collect()}
    got = {r["module"]: r["area"] for r in run(spark, small, "g9_areas")}
    assert set(got) == ids
    label = {i: n[i]["domain"] if len(i) % 4 and n[i]["category"] not in ("shared-utility", "test-surface",
        "external-integration") else None for i in ids}
    near = {i: set() for i in ids}
    for r in B.edges(spark, small).where("confidence = 'confirmed'").collect():
        if label[r["source"]] and label[r["source"]] == label[r["target"]]:
            near[r["source"]].add(r["target"])
            near[r["target"]].add(r["source"])
    for i in ids:
        group = steps_from(i, near)
        if label[i] and any(len(j) % 5 == 0 for j in group):
            assert got[i] == f"group:function:s:{label[i]}"
        elif label[i] and len(group) > 1:
            assert got[i].startswith(f"group:function:s:{label[i]}:") and {got[j] for j in group} == {got[i]}
        else:
            assert got[i].endswith(f":s:{i}")


def test_fingerprint_sees_every_edge(spark, small):
    from lodestrata.operators import graph

    n, e = B.nodes(spark, small), B.edges(spark, small)
    one = e.orderBy("id").first()
    less = e.where((e["source"] != one["source"]) | (e["target"] != one["target"]))
    got = run(spark, small, "g13_fingerprint")
    assert got == graph.fingerprint(n.repartition(3), e.repartition(5)).collect() != graph.fingerprint(n,
        less).collect()
