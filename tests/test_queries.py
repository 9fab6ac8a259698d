"""Every query of the library against its SQL twin, row by row."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from syncframe import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, duck, name):
    frame = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in plans.ORACLES:
        assert got
        return
    cursor = duck.execute(plans.ORACLES[name])
    named = [d[0] for d in cursor.description]
    assert sorted(named) == columns
    places = [named.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in places) for r in cursor.fetchall()), key=repr)


def test_orders(spark, sf_dir):
    paths = [r.path for r in plans.QUERIES["manifest_order"](spark, sf_dir).collect()]
    assert paths == sorted(paths, key=lambda p: p.split("/"))
    paths = [r.path for r in plans.QUERIES["delete_order"](spark, sf_dir).collect()]
    assert paths == sorted(paths, reverse=True)


def test_plans_push_down(spark, sf_dir):
    plan = plans.QUERIES["chunk_size_for"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double>" in plan
    for name in ("quick_check", "delta_chunks", "chunk_id", "room_state"):
        plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan
