"""Every registered query against its SQL on the same tables: names, types, rows, values."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry_module
from hexheat.plans import catalogue
from hexheat.plans.catalogue import QUERIES
from hexheat.plans.checks import CHECKS as SQL
from hexheat.sources import derived as D

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
    "smallint": "SMALLINT", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(rows):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6) + 0.0
        return v

    return sorted((tuple(value(v) for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    described = {row[0]: row[1] for row in duck.sql("DESCRIBE " + SQL[name]).fetchall()}
    assert {f.name: TYPES.get(f.dataType.simpleString()) for f in df.schema} == described
    ours = canonical(tuple(row) for row in df.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = canonical(duck.sql(f"SELECT {quoted} FROM ({SQL[name]})").fetchall())
    assert ours and ours == theirs


# Queries over the whole archive, whose number of runs follows the number of orders; others read the same steps.
ARCHIVE = (
    "fold_cell_hour fold_by_sql heat_index_film sustained_heat frame_means param_sweep load_ramp_top index_ramp densified_film "
    "pick_points newest_run_wins masked_fold write_dense_film cell_series films_of_requests film_config run_extent"
).split()
A_WEEK = f"// {D.ORDERS_A_WEEK} "


@pytest.mark.parametrize("name", ARCHIVE)
def test_query_equals_its_sql_over_several_weeks(spark, sf, duck, name, monkeypatch):
    """With fewer orders a week the same tables are an archive of five weeks."""
    assert A_WEEK in SQL[name]
    monkeypatch.setattr(D, "ORDERS_A_WEEK", 300)
    monkeypatch.setattr(catalogue, "CUBES", {})
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = canonical(tuple(row) for row in df.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = canonical(duck.sql(f"SELECT {quoted} FROM ({SQL[name].replace(A_WEEK, '// 300 ')})").fetchall())
    assert ours and ours == theirs


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries()) and set(SQL) <= set(entry_module.oracle_sql())


def test_entry_runs(spark):
    assert entry_module.entry(spark).count() > 0
