"""Every registered query against its SQL in DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from caseflow.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in registry.ORACLE_SQL:
        assert df.columns
        return
    cur = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = rows(names, cur.fetchall())
    assert got == want
    assert want


def test_resolution_has_something_to_decide(spark):
    """Every verdict, matches with and without an equal name, and several kinds of conflict."""
    found = registry.QUERIES["resolve_entities"](spark, "/root/testdata/sf0.01").collect()
    assert {r.verdict for r in found} == {"EXACT_MATCH", "AMBIGUOUS", "NEW_ENTITY"}
    assert {r.name_agrees for r in found if r.verdict == "EXACT_MATCH"} == {True, False, None}
    assert {"phone", "account", "vehicle", "identity"} <= {r.detail for r in found if r.verdict == "EXACT_MATCH"}
    assert len({r.detail for r in found if r.verdict == "NEW_ENTITY"}) >= 3 and any(r.verdict == "AMBIGUOUS" and r.detail == "name" for r in found)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
