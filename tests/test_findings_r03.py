"""Work on small tables is dealt to all tasks; edges are combined by numbers."""

from __future__ import annotations

import __spark_entry__ as entry


def test_small_tables_with_heavy_work_are_dealt(spark, small):
    for name in ("x10_sql_tables", "e10_python_facts", "e3_text_facts"):
        assert entry.queries()[name](spark, small).rdd.getNumPartitions() > 1, name


def test_edges_are_combined_by_numbers(spark, small):
    from lodestrata.sources import bridge

    plan = bridge.edges(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan  # texts as aggregates would sort all relations twice


def test_the_latest_event_of_an_edge_is_by_text(spark, tmp_path):
    from lodestrata.sources import bridge

    parts = (9, 103, 1004, 12, 123)  # as texts the last is 9
    lines = [(1, n, p, 1, "F") for n, p in zip((1, 4, 7, 10, 13), parts, strict=True)] + [(1, 3, 1, 1, "O"), (1, 5, 77, 1, "O"), (1, 1, 20, 1, "F"), (1, 2, 34, 1, "F")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5, "4-NOT")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    found = {r["id"]: (r["confidence"], r["event_id"], r["origin"], r["n_relations"]) for r in bridge.edges(spark, str(tmp_path)).collect()}
    assert found == {"supplier/1:customer/5:publishes_event": ("confirmed", "part9", None, 5), "customer/5:supplier/1:subscribes_event": ("inferred", None, None, 1),
        "supplier/1:customer/5:event": ("inferred", None, "manual", 1), "supplier/1:resource/4:event": ("confirmed", "part34", None, 1)}


def test_declarations_make_no_other_facts(spark, small, monkeypatch):
    from lodestrata.operators import source_facts

    written, real = [], source_facts.settled
    monkeypatch.setattr(source_facts, "settled", lambda df: written.append(df.columns) or real(df))
    found = entry.queries()["e2_declarations"](spark, small)
    assert len(written) == 4 and found.columns == ["path", "name", "kind", "arity"]


def test_relations_are_combined_by_numbers(spark, small):
    from lodestrata.operators import relations
    from lodestrata.sources import bridge

    classes = bridge.relation_classes(spark, small)
    assert "SortAggregate" not in classes._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(repr, df.collect()))
    for made in (relations.relationships, relations.skipped, relations.outcomes):
        assert rows(made(classes, None)) == rows(made(bridge.relations(spark, small), bridge.module_files(spark, small))), made
    numbers = [0, 5, 9, 10, 12, 100, 103, 1004, 7_200_000]
    found = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", bridge.text_order(bridge.F.col("n")).alias("code")).orderBy("code").select(bridge.ordered_number("code")).collect()
    assert [r[0] for r in found] == sorted(map(str, numbers))


def test_matches_are_dealt_by_key_once(spark):
    from lodestrata.operators import assembly

    row = "id string, source string, target string, relation string, pending boolean"
    old = spark.createDataFrame([("a", "1", "2", "r", False), ("b", "1", "2", "r", False), ("c", "1", "3", "r", False), ("d", "1", "3", "r", False), ("e", "2", "3", "r", True), ("f", "2", "1", "r", False), ("h", "3", "1", None, False)], row)
    new = spark.createDataFrame([("a", "n1", "n2", "r", False), ("x", "n1", "n2", "r", False), ("y", "n1", "n3", "r", False), ("e", "n2", "n3", "r", False), ("z", "n2", "n1", "r", False), ("h", "n3", "n1", None, False)], row)
    ids = spark.createDataFrame([(n, f"n{n}") for n in "123"], "old_id string, new_id string")
    found = assembly.matched_relations(old, new, ids)
    assert sorted((r["old_id"], r["new_id"]) for r in found.collect()) == [("a", "a"), ("b", "x"), ("f", "z")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2  # the two ends of the old ones; before, matches were joined again and again


def test_components_go_round_by_numbers(spark, monkeypatch):
    from lodestrata.operators import graph

    written, real = [], graph.settled
    monkeypatch.setattr(graph, "settled", lambda df: written.append(dict(df.dtypes)) or real(df))
    nodes = spark.createDataFrame([(x,) for x in ("n10", "n9", "n2", "n1", "lone")], "id string")
    edges = spark.createDataFrame([("n9", "n10"), ("n2", "n9"), ("n1", "gone"), ("gone", "n2"), ("n1", "n1")], "source string, target string")
    assert {tuple(r) for r in graph.components(nodes, edges).collect()} == {("n10", "n10"), ("n9", "n10"), ("n2", "n10"), ("n1", "n1"), ("lone", "lone")}
    assert all(kind != "string" for d in written if "before" in d for kind in d.values())


def test_relations_are_sorted_by_numbers_once(spark, small, monkeypatch):
    from lodestrata.operators import dedupe
    from lodestrata.sources import bridge

    rows = lambda df: sorted(map(repr, df.collect()))
    columns = ["id", "source_file", "target_file", "kind", "symbol", "detail", "confidence"]
    assert rows(bridge.relation_texts(bridge.relation_numbers(spark, small)).select(columns)) == rows(bridge.relations(spark, small).select(columns))
    plan = entry.queries()["d1_relations_once"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "sha2" in plan.split("Exchange hashpartitioning(id")[1]
    asked = []
    real = dedupe.with_number
    monkeypatch.setattr(dedupe, "with_number", lambda df, order, name, buckets: asked.append((dict(df.dtypes), buckets)) or real(df, order, name, buckets))
    entry.queries()["t6_relation_order"](spark, small)
    assert {asked[0][0][c] for c in ("source_file", "target_file")} == {"bigint"} and asked[0][1] == 8
    plan = entry.queries()["j21_evidence"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") == 2  # evidence meets the first relation of its key and is not joined back


def test_a_round_of_binding_joins_once(spark):
    from lodestrata.operators import binding

    rows = [("package", "member", "A", "module", [], ["p"]), ("deeper", "member", "q", "module", [], ["p"]), ("gone", "member", "x", "module", [], ["p"]), ("own", "member", "f", "declaration", ["c"], []),
        ("field", "member", "g", "declaration", ["c"], []), ("made", "call", None, "declaration", ["c"], []), ("face", "member", "f", "declaration", ["i"], []), ("alias", "alias", "x", "external", [], ["m"])]
    rows = spark.createDataFrame([(n, op, name, "s", "java", k, refs, m, True, None, None) for n, op, name, k, refs, m in rows], f"node string, op string, name string, of string, language string, {binding.IDENTITY}")
    given = ("declaration", ["a"], [], False, None, None)
    known = [("j", "s", "p\0A", None, None, None, None, given, (True, "f"), ["a"], None, None, None), ("p", "s", "p.q", None, None, None, None, None, None, None, None, True, None), ("d", "c", "", True, False, *[None] * 8),
        ("d", "i", "", True, True, *[None] * 8), ("d", "c", "f", *[None] * 9, "c#f"), ("d", "c", "g", None, None, True, "value", *[None] * 6)]
    known = spark.createDataFrame(known, f"sort string, ref string, key string, is_class boolean, face boolean, field boolean, field_dep string, export struct<{binding.IDENTITY.replace(' ', ':').replace(',:', ',')}>, "
        "place struct<declared:boolean,path:string>, all_refs array<string>, files array<string>, package boolean, member string").withColumns({"usable": binding.F.lit(False), "inherited": binding.F.lit(False)})
    b = object.__new__(binding.Binder)
    b.round = binding._round()
    got = b._apply(rows, known)
    assert got._jdf.queryExecution().analyzed().toString().count("Join ") == 1  # before, about thirty
    found = {r["node"]: (r["kind"], r["refs"], r["members"], r["dep"]) for r in got.collect()}
    # a name of a package holds none of its files, so that names times files are not written
    assert found["package"] == ("declaration", ["a"], [], None) and found["deeper"] == ("module", [], ["p.q"], None) and found["gone"][0] == found["face"][0] == "unresolved"
    assert found["own"] == ("declaration", ["c#f"], [], None) and found["field"] == (None, None, None, "value") and found["made"][:2] == ("declaration", ["c"]) and found["alias"] == ("external", [], ["m"], None)


def test_lone_files_are_merged_in_rounds(spark):
    import random

    import pandas as pd

    from lodestrata.operators import clustering

    dice = random.Random(5)
    names = ["a", "a-b", "a-b-c", "a-b-c-d", "b", "b-a", "b-a-c", "c"]
    keys = {f"f{n}": (f"k{dice.randrange(10_000)}-{n}", dice.choice(names)) for n in range(300)}
    users = {n: {n, *([n - 2] if n > 1 else []), *([dice.randrange(150) * 2 + n % 2] if n % 3 == 0 else [])} for n in range(300)}
    rows = [(f"s{n % 2}", *keys[f"f{n}"][:1], f"f{n}", keys[f"f{n}"][1], f"f{u}", *keys[f"f{u}"]) for n in users for u in users[n]]
    near = spark.createDataFrame(rows, "scope string, key string, file string, name string, source_file string, s_key string, s_name string")
    pdf = near.toPandas()
    one = pd.concat(clustering._merge_alone(p) for _, p in pdf.groupby("scope"))
    expected = {(f, None if a else j, bool(a)) for f, j, a in one.itertuples(index=False)}
    assert {a for _, _, a in expected} == {True, False}
    for rounds in (20, 1):  # to the end, and with the rest in Python groups
        assert {tuple(r) for r in clustering.merge_alone(near, rounds).collect()} == expected
    # nothing of a scope goes through one Python group where no chain is long
    assert "FlatMapGroupsInPandas" not in clustering.merge_alone(near)._jdf.queryExecution().optimizedPlan().toString()


def test_roles_read_a_path_once(spark):
    from pyspark.sql import functions as F

    from lodestrata.functions import scalars as X

    df = spark.createDataFrame([("src/api/userController.ts", "feature"), ("a/plain.py", "unknown"), ("a/plain.py", "feature"), ("tests/x.py", "feature"), ("a/b.py", "external")], "file string, kind string")
    got = df.select(X.role_signals(F.col("file"), F.col("kind")).alias("r"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("concat_ws( ") == 1  # before, once a role
    found = [r["r"] for r in got.collect()]
    assert "api-boundary" in found[0] and found[1:] == [["unknown"], ["domain-service"], ["test-surface"], ["external-integration"]]
