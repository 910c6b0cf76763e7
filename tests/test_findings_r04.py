"""Less is written and dealt, with the same results."""

from __future__ import annotations

import __spark_entry__ as entry


def test_declarations_write_telling_words_only(spark, small, monkeypatch):
    from lodestrata.operators import source_facts
    from lodestrata.sources import bridge

    written, real = [], source_facts.settled

    def counting(df):
        out = real(df)
        written.append(out.count())
        return out

    files = bridge.sources(spark, small).where("path like '%1%'")
    words = source_facts._words(files).count()
    monkeypatch.setattr(source_facts, "settled", counting)
    source_facts.declarations(files)
    assert written[0] < 0.5 * words and written[3] < 0.05 * words  # before, each was all words


def test_nested_scopes_place_words(spark):
    from pyspark.sql import functions as F

    from lodestrata.operators import source_facts

    text = "class A {\n  run(a, [b, c]) { const f = (x) => g(x, {}); return f; }\n  static go() { }\n}\nfunction top(a, b,) { const h = function () { if (a) { b(); } }; }\n"
    files = spark.createDataFrame([("a.ts", "typescript", text), ("e.ts", "typescript", ""), ("p.py", "python", "x = 1\n\ndef f(a, b=(1, 2)):\n    return [lambda v: v for v in a]\n\nclass B(A):\n    def m(self): pass\n")],
        "path string, language string, content string")
    found = source_facts.declarations(files)
    assert sorted((r["path"], r["name"], r["kind"], r["arity"], r["static"]) for r in found.collect()) == [("a.ts", "A", "class", None, False), ("a.ts", "f", "function", None, False), ("a.ts", "go", "function", 0, True), ("a.ts", "h",
        "function", None, False), ("a.ts", "run", "function", 2, False), ("a.ts", "top", "function", 2, False), ("p.py", "B", "class", None, False), ("p.py", "f", "function", 2, False), ("p.py", "m", "function", 1, False)]
    whole = source_facts.facts(files)
    columns = ["path", "name", "kind", "begin", "scope", "arity", "static", "final", "interface", "word", "open", "line", "column", "end"]
    rows = lambda df: sorted(map(repr, df.select(columns).collect()))
    assert rows(found) == rows(whole.declarations)
    # the innermost scope of each word, by plain comparison
    scopes = [(r["path"], r["begin"], r["end"]) for r in whole.scopes.collect()]
    for w in whole.words.select("path", "i", "scope").collect():
        around = [(b, -e) for p, b, e in scopes if p == w["path"] and b <= w["i"] <= e]
        assert w["scope"] == max(around, default=(-1, 0))[0], w


def test_evidence_is_dealt_once_and_where_it_is_asked(spark, tmp_path):
    lines = [(1, n, p, s, "N", "F") for n, p, s in ((1, 4, 7), (2, 4, 7), (3, 5, 7), (4, 3, 8), (5, 7, 8), (5, 7, 8), (6, 3, 8))] + [(2, 1, 3, 8, None, "O"), (2, 1, 4, 8, "N", "O"), (3, 1, 4, 7, "N", "F"), (None, 1, 4, 7, "N", "F")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 5, "2-HIGH"), (2, 5, "2-HIGH"), (3, 5, "1-URGENT"), (3, 6, "1-URGENT"), (None, 7, "1-URGENT")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    from lodestrata.sources import bridge

    # a line twice, or an order twice, is no single relation
    numbers = bridge.relation_numbers(spark, str(tmp_path)).collect()
    ids = [bytes(r["id"]) for r in numbers]
    assert len(ids) == 11 and sorted(bytes(r["id"]) for r in bridge.single_relations(spark, str(tmp_path)).collect()) == sorted(x for x in ids if ids.count(x) == 1)
    found = entry.queries()["j21_evidence"](spark, str(tmp_path))
    first = min(bytes(r["id"]) for r in numbers if r["symbol"] == 3 and r["detail"]["flag"] == "N")
    by_part = {bytes(r["id"]).hex(): (r["symbol"], r["detail"]["flag"], r["confidence"]) for r in numbers}
    expected = {i: "confirmed" if p % 5 and not c else "inferred" for i, (p, f, c) in by_part.items() if ids.count(bytes.fromhex(i)) == 1}
    assert {r["evidence_id"]: r["confidence"] for r in found.collect()} == expected and first.hex() in expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" not in plan and "hashpartitioning(r_symbol" not in plan and "coalesce(r_symbol" not in plan  # before, all relations were dealt by id, four times


def test_nothing_said_is_equal_in_evidence(spark):
    from lodestrata.operators import assembly

    evidence = spark.createDataFrame([("a", "r1", "f", "s", None), ("b", None, "f", None, "d"), ("c", None, "f", "s", "d"), ("d", None, None, "s", "d"), ("e", "r2", "f", "s", "d"), ("f", None, "f", "t", None)],
        "evidence_id string, relation_id string, file string, symbol string, detail string")
    relations = spark.createDataFrame([(1, "r1", "f", "s", None, "confirmed"), (3, "r2", "f", None, "d", "x"), (2, "r3", "f", None, "d", "confirmed"), (4, None, None, "s", "d", "confirmed"), (5, "r4", "f", "t", "d", "confirmed")],
        "place int, id string, source_file string, symbol string, detail string, confidence string")
    found = {r["evidence_id"]: r["confidence"] for r in assembly.evidence_confidence(evidence, relations).collect()}
    assert found == {"a": "confirmed", "b": "confirmed", **dict.fromkeys("cdef", "inferred")}
