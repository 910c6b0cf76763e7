"""Queries over all files of a module, not over a part of them."""

from lodestrata.plans import graph_queries, registry, scalar_queries  # noqa: F401


def by_module(spark, small, name, column):
    return {r["module"]: r[column] for r in registry.QUERIES[name](spark, small).collect()}


def test_files_outside_the_part_count(spark, small):
    assert by_module(spark, small, "x13_common_directory", "folder")["src0"] == "src0"
    assert by_module(spark, small, "x21_technology", "stacks")["src13"] == "frontend,backend,data"
    assert by_module(spark, small, "a10_unique_label", "scope")["src10"] is None


def test_calls_resolve_over_all_declarations(spark, small):
    rows = registry.QUERIES["j13_callables"](spark, small).collect()
    assert {r["candidates"] for r in rows} >= {0, 1, 2}
    assert any(r["target"] >= 60 and r["target"] % 25 for r in rows)
    assert all((r["target"] >= 0) == (r["candidates"] == 1) for r in rows)


def test_lines_behind_the_first_500_characters_count(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 600 + "\n\ny"), (2, "")], "doc_id long, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["line"] for r in registry.QUERIES["x23_lines"](spark, str(tmp_path)).collect()} == {1: 3,
        2: 1}
