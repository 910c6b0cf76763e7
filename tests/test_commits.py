"""Generations: one of two writers wins, and nothing half written or changed underneath is published."""

import threading

import pytest

from lodestrata.operators import assembly
from lodestrata.sources import files as scans
from lodestrata.sources import sinks


def test_one_of_two_writers_wins(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    first = sinks.publish(spark, root, {"t": spark.range(3)})
    gate, outcomes = threading.Barrier(4), []

    def write(n):
        gate.wait()
        try:
            outcomes.append(sinks.publish(spark, root, {"t": spark.range(n)}, expected=first))
        except sinks.Conflict:
            outcomes.append(None)

    threads = [threading.Thread(target=write, args=(10 + n,)) for n in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [x for x in outcomes if x]
    assert len(outcomes) == 4 and len(won) == 1 and sinks.current(spark, root) == won[0]
    # without an expectation all are published, one after the other
    more = [sinks.publish(spark, root, {"t": spark.range(n)}) for n in (1, 2)]
    assert sinks.current(spark, root) == more[1] and sinks.load(spark, root, "t").count() == 2


def test_a_name_is_taken_once(spark, tmp_path):
    taken = []
    threads = [threading.Thread(target=lambda n=n: taken.append(sinks.put_new(spark, f"file://{tmp_path}/x/name", f"text {n}"))) for n in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(taken) == [False] * 15 + [True] and len(list((tmp_path / "x").iterdir())) == 1


def test_changed_inputs_refuse_a_generation(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.py").write_text("x = 1")
    (src / "b.py").write_text("y = 1")
    hashed = lambda: scans.contents(spark, str(src)).selectExpr("path", "sha2(content, 256) AS hash")
    pinned = spark.createDataFrame(hashed().collect())
    root = f"file://{tmp_path}/store"
    sinks.publish(spark, root, {"t": pinned}, checks=[assembly.snapshot_changes(pinned, hashed())])
    before = sinks.current(spark, root)
    (src / "b.py").write_text("y = 2")
    with pytest.raises(sinks.Conflict, match="changed"):
        sinks.publish(spark, root, {"t": pinned}, checks=[assembly.snapshot_changes(pinned, hashed())])
    assert sinks.current(spark, root) == before


def test_saving_a_graph(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = spark.createDataFrame([("e", "a", "b")], "id string, source string, target string")
    files = spark.createDataFrame([("f1", "a"), ("f2", "b")], "file string, module string")
    known = spark.createDataFrame([("f1",), ("f2",), ("f3",)], "file string")
    first = sinks.publish(spark, root, {"nodes": nodes, "edges": edges, "files": files}, revision=4)
    save = lambda n=nodes, e=edges, f=files, g=first, r=4: sinks.save_graph(spark, root, n, e, f, known, g, r)
    wrong = [(dict(g="other"), "no longer"), (dict(r=3), "revision"), (dict(n=nodes.unionAll(nodes)), "repeated-node"), (dict(e=edges.unionAll(edges)), "repeated-edge"),
        (dict(e=spark.createDataFrame([("e", "a", "z")], edges.schema)), "unknown-end"), (dict(f=files.unionAll(spark.createDataFrame([("f1", "b")], files.schema))), "owned-twice"),
        (dict(f=spark.createDataFrame([("nowhere", "a")], files.schema)), "unknown-file")]
    for change, why in wrong:
        with pytest.raises(sinks.Conflict, match=why):
            save(**change)
    second = save()
    assert sinks.newest(spark, root)["revision"] == 5 and sinks.current(spark, root) == second
    with pytest.raises(sinks.Conflict):
        save()
