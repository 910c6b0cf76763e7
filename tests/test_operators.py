"""Scenarios for operators whose results SQL does not check."""

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import scalars as X
from lodestrata.operators import clustering, dedupe, extraction, graph, relations, sequences, views
from lodestrata.sources import configs, files, sinks
from lodestrata.streaming import events as streams


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


CODE = ["src/features/billing/billing.service.ts", "src/features/billing/storage/invoice.repository.ts",
    "src/main/services/billing-format.ts", "src/features/identity/identity.controller.ts",
    "src/features/notifications/notifications.worker.ts", "src/integrations/stripe/stripe.adapter.ts",
    "tests/billing.service.test.ts", "src/shared/date.util.ts"]


def test_clusters_follow_features_and_share_what_three_domains_use(spark):
    f = spark.createDataFrame([(p, "s") for p in CODE], "file string, scope string")
    calls = [(CODE[0], CODE[7]), (CODE[3], CODE[7]), (CODE[4], CODE[7]), (CODE[0], CODE[2])]
    r = spark.createDataFrame([("call", a, b, "confirmed") for a, b in calls],
        "kind string, source_file string, target_file string, confidence string")
    found = {x["file"]: x["cluster"] for x in clustering.clusters(f, r).collect()}
    assert found[CODE[0]] == found[CODE[1]] == "feature:src/features/billing"
    assert found[CODE[7]] == "shared:utilities"
    assert found[CODE[5]] == "external:stripe"
    assert found[CODE[6]].startswith("tests:")
    again = {x["file"]: x["cluster"] for x in clustering.clusters(f.orderBy(F.rand(3)).repartition(3), r.repartition(3))
        .collect()}
    assert again == found


def test_endpoints_match_only_a_unique_route_of_the_same_service(spark):
    data = [("q1", "request", "GET", "/users/7", "a", None), ("r1", "route", "GET", "/users/:id", "a", None), ("q2",
        "request", "POST", "/users/7", "a", None), ("q3", "request", "GET", "/users/7", None, None), ("q4", "request",
        "GET", "/x/y", "b", None), ("r2", "route", "GET", "/x/:a", "b", None), ("r3", "route", "GET", "/:b/y", "b",
        None)]
    e = spark.createDataFrame([(*d, "confirmed") for d in data], "id string, kind string, method string, path string, "
        "service string, origin string, confidence string")
    assert rows(relations.match_endpoints(e), "request", "route") == [("q1", "r1")]


def test_strong_components_and_layers(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "id string")
    edges = spark.createDataFrame([tuple(x) for x in ["ab", "ba", "bc", "cd", "dc", "de", "ff"]],
        "source string, target string")
    parts = graph.strong_components(nodes, edges)
    assert rows(parts, "id", "component", "cyclic") == [("a", "a", True), ("b", "a", True), ("c", "c", True), ("d", "c",
        True), ("e", "e", False), ("f", "f", True)]
    flat = graph.condensed(edges, parts)
    tops = parts.select(F.col("component").alias("id")).distinct()
    assert rows(graph.layers(tops, flat), "id", "depth") == [("a", 0), ("c", 1), ("e", 2), ("f", 0)]
    with pytest.raises(RuntimeError):
        graph.layers(nodes, edges, 20)


def test_components_of_a_long_chain(spark):
    n = 60
    nodes = spark.createDataFrame([(f"{i:03}",) for i in range(n)], "id string")
    edges = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(n - 1) if i != 30],
        "source string, target string")
    assert rows(graph.components(nodes, edges).select("component").distinct(), "component") == [("000",), ("031",)]


def test_greedy_fill_skips_what_does_not_fit(spark):
    items = spark.createDataFrame([("o", "a", "k", 60, 1, False), ("o", "b", "k", 50, 2, False), ("o", "c", "k", 30, 3,
        False), ("o", "m", "k", 10, 9, True)], "owner string, id string, kind string, size int, rank int, mandatory "
        "boolean")
    assert rows(sequences.fill(items, 100), "id", "left") == [("a", 30), ("c", 0), ("m", 90)]


def test_python_facts_and_errors(spark):
    code = "import os\nfrom .a import b\nclass C(Base):\n    def f(self, x):\n        os.path.join(x, b(1))\n"
    f = spark.createDataFrame([("m.py", code), ("bad.py", "def (")], "path string, content string")
    found = {(r["path"], r["fact"], r["name"]) for r in extraction.python_facts(f).collect()}
    assert {("m.py", "import", ".a.b"), ("m.py", "class", "C"), ("m.py", "inherit", "Base"), ("m.py", "call",
        "os.path.join"), ("bad.py", "error", "SyntaxError")} <= found


def test_endpoints_in_source(spark):
    code = "fetch('/api/users?x=1'); axios.post(\"/api/orders/${id}\"); app.get('/a/:id', h); @GetMapping(\"/s\") r.GET(\"/g\", h)"
    f = spark.createDataFrame([("a.ts", code)], "path string, content string")
    assert rows(extraction.endpoints(f), "kind", "method", "normal") == [("request", "GET", "/api/users"), ("request",
        "POST", "/api/orders/:param"), ("route", "GET", "/a/:param"), ("route", "GET", "/g"), ("route", "GET", "/s")]


def test_first_json_prefers_fenced_blocks_and_opens_envelopes():
    assert extraction.first_json('x {"a": 1} ```json\n{"b": 2}\n```') == '{"b":2}'
    assert extraction.first_json('{"result": "{\\"key\\": 1}"}', "key") == '{"key":1}'
    assert extraction.first_json("nothing {broken") is None


def test_configs():
    assert configs.read_config("a/package.json", '{"name": "p", "workspaces": ["x/*"], "dependencies": {"b": "1"}}')[
        1:6] == ("npm", "p", None, ["x/*"], ["b"])
    assert configs.read_config("pyproject.toml", '[project]\nname = "q"\ndependencies = ["numpy>=1"]')[2:6] == ("q",
        None, [], ["numpy"])
    assert configs.read_config("pom.xml",
        "<project><artifactId>z</artifactId><modules><module>m</module></modules></project>")[2:5] == ("z", None, ["m"])
    assert configs.read_config("go.mod", "module ex.org/a\n\nrequire (\n\tex.org/b v1.2.3\n)\n")[2:6] == ("ex.org/a",
        None, [], ["ex.org/b"])
    assert configs.read_config("pnpm-workspace.yaml", "packages:\n  - 'a/*'\n  - b\nother: 1\n")[4] == ["a/*", "b"]
    assert configs.read_config("package.json", "{broken")[6] == "JSONDecodeError"


def test_generations_become_visible_at_once(spark, tmp_path):
    root = f"file://{tmp_path}"
    assert sinks.current(spark, root) is None
    first = sinks.publish(spark, root, {"t": spark.range(3)})
    second = sinks.publish(spark, root, {"t": spark.range(5)}, expected=first)
    assert sinks.current(spark, root) == second and sinks.load(spark, root, "t").count() == 5
    with pytest.raises(RuntimeError):
        sinks.publish(spark, root, {"t": spark.range(1)}, expected=first)


def test_scan_ignores_folders_and_secrets(spark, tmp_path):
    for p in ("a/x.ts", "a/node_modules/y.ts", "b/.env", "b/z.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("hello")
    assert rows(files.scan(spark, str(tmp_path)), "path", "size", "language") == [("a/x.ts", 5, "TypeScript"), (
        "b/z.py", 5, "Python")]


def test_empty_inputs(spark):
    nodes, edges = spark.createDataFrame([], "id string"), spark.createDataFrame([], "source string, target string")
    assert graph.components(nodes, edges).count() == graph.strong_components(nodes,
        edges).count() == graph.reachable(edges, nodes).count() == 0
    assert dedupe.with_number(nodes, ["id"], "n", 4).count() == 0
    assert views.why_empty(spark.createDataFrame([], "id string, layer string, stacks array<string>, domain "
        "string")).first()["state"] == "empty"


def test_paths_at_the_edge(spark):
    df = spark.createDataFrame([("a.ts",), ("/a/../b/./c",), ("../../x",)], "p string")
    got = df.select(F.size(X.folders(F.col("p"))).alias("n"), X.joined_path(F.col("p")).alias("j")).collect()
    assert [(r["n"], r["j"]) for r in got] == [(0, "a.ts"), (4, "/b/c"), (2, "../../x")]


def test_streamed_windows_equal_static_ones(spark, small, tmp_path):
    static = spark.read.parquet(f"{small}/events.parquet")
    marks = str(tmp_path / "marks")
    source = streams.read(spark, small, static.schema, "events.parquet")
    q = streams.tumbling(source, late="365 days").writeStream.outputMode("complete").format("memory").queryName(
        "tumbled").option("checkpointLocation", marks).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("tumbled"), "start", "event_type", "n") == rows(streams.tumbling(static), "start",
        "event_type", "n") != []
