"""Every query of the library's own operators against its SQL in DuckDB."""

import math
import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.plans import queries as plans
from sparkloom.tables import shared_dir


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, (float, Decimal)):
        return "nan" if math.isnan(x) else round(float(x), 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf, duck, name):
    home = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(home))
    df = plans.QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(set(os.listdir(home)) - before) <= 1  # nothing but the result is left behind
    if name in plans.ORACLE:
        cursor = duck.execute(plans.ORACLE[name])
        assert got == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_registration(spark):
    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns


def test_rest_imports_without_the_corpus_operators(monkeypatch):
    monkeypatch.setattr(entry, "_llm", lambda: None)
    assert set(entry.queries()) == set(plans.QUERIES) and set(entry.oracle_sql()) == set(plans.ORACLE)
