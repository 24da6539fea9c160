"""The queries against their SQL at the smallest size."""

import glob
import os

import duckdb
import pytest

from recallgrid.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    # a query that finds nothing shows nothing; all facts are one large cluster at this size, small_clusters has others
    assert (rows or name == "fact_clusters") and name in catalog.ORACLE_SQL
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)


def test_window_ends_with_its_last_second(spark, tmp_path):
    stamps = ["2024-01-13 23:59:59.999999", "2024-01-14 00:00:00", "2024-01-17 23:59:58.9", "2024-01-17 23:59:59", "2024-01-17 23:59:59.000001", "2024-01-17 23:59:59.5", "2024-01-16 23:59:59.5", "2024-01-18 00:00:00"]
    rows = ", ".join(f"({i}, TIMESTAMP '{t}')" for i, t in enumerate(stamps))
    path = f"{tmp_path}/events.parquet"
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM (VALUES {rows}) v(event_id, ts)) TO '{path}' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    got = sorted(tuple(r) for r in catalog.QUERIES["calendar_window"](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(catalog.ORACLE_SQL["calendar_window"]).fetchall()) and [i for i, _ in got] == [1, 2, 3, 6]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["fingerprints", "analogize"])
def test_edges_are_folded_once_for_fingerprints(spark, monkeypatch, name):
    from recallgrid.operators import store

    folded, fold = [], store.seen_edges
    monkeypatch.setattr(store, "fold_edges", lambda log: pytest.fail("sorts rows of strings"))
    monkeypatch.setattr(store, "seen_edges", lambda log: folded.append(1) or fold(log))
    found = catalog.QUERIES[name](spark, SF)
    assert found.count() > 0 and len(folded) == 1
