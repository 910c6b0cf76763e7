"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import decimal
import math

import duckdb
import pytest

from lodestrata.plans import assembly_queries, graph_queries, registry, scalar_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if v is not None and not isinstance(v, (str, bool)) else v


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, duck, name):
    found = registry.QUERIES[name](spark, small).toPandas()
    assert len(found) > 0  # an empty result would show nothing
    if name not in registry.ORACLES:
        return
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == sorted(found.columns)
    rows = [tuple(plain(v) for v in r) for r in found[want.columns].itertuples(index=False, name=None)]
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(v) for v in r)) for r in want.fetchall())
