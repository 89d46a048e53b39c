"""The registered queries: against their SQL where there is one, and all of them over whole tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from hexheat.llm import queries

SIZES = {f"op{n}_": "embeddings" if n == 6 else "pages" if n == 4 else "documents" for n in range(1, 14)}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    assert columns == sorted(r[0] for r in duck.sql("DESCRIBE " + queries.CHECKS[name]).fetchall())
    ours = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert ours == sorted(duck.sql(f"SELECT {', '.join(columns)} FROM ({queries.CHECKS[name]})").fetchall(), key=repr)


@pytest.mark.parametrize("prefix", ["op3_", "op4_", "op7_", "op10_", "op13_"])
def test_query_has_a_row_for_every_row(spark, sf, prefix):
    name = next(n for n in queries.QUERIES if n.startswith(prefix))
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{SIZES[prefix]}.parquet").count()


def test_all_are_registered():
    assert all(any(n.startswith(p) for n in entry.queries()) for p in SIZES) and "pipeline" in entry.queries()
    assert set(queries.CHECKS) <= set(entry.oracle_sql())
