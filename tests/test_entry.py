"""The registered queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from tidemark.plans import queries as plans

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_of_the_library_is_registered():
    assert plans.QUERIES.keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(ours.columns)
    relation = duck.sql(plans.ORACLES[name])
    assert columns == sorted(relation.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in ours.collect()), key=repr)
    at = [relation.columns.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.ORACLES.keys()))
def test_query_runs(spark, name):
    assert plans.QUERIES[name](spark, FOLDER).count() > 0


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    """Events of more users than a bounded summary of a shard holds, all about as frequent; some without user or time."""
    folder = str(tmp_path_factory.mktemp("crowd"))
    connection = duckdb.connect()
    connection.sql("CREATE TABLE events AS SELECT k AS event_id, CASE WHEN k % 997 <> 0 THEN TIMESTAMP '2024-01-01' + to_seconds(k * 7 % 172800) END AS ts, CASE WHEN k % 1009 <> 0 THEN k * k % 14983 END AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{}' AS props FROM (SELECT unnest(range(30000)) AS k)")
    connection.sql(f"COPY events TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder, connection


@pytest.mark.parametrize("name", ["topk_fast_windows", "topk_fast_total", "topk_compare", "topk_precision"])
def test_every_item_is_a_candidate(spark, crowd, name):
    folder, connection = crowd
    ours, relation = plans.QUERIES[name](spark, folder), connection.sql(plans.ORACLES[name])
    at = [relation.columns.index(c) for c in ours.columns]
    want = sorted((tuple(r[i] for i in at) for r in relation.fetchall()), key=repr)
    assert want and sorted(map(tuple, ours.collect()), key=repr) == want
