"""Joins by row identity hold a bounded number of rows a task, however many rows a table and its changes have."""

import threading

import pytest

from orrery import database
from orrery.sources import manifest as M
from orrery.sources import store
from orrery.sources.files import Folder
from orrery.status import StatusCode


@pytest.fixture
def few_rows(monkeypatch):
    monkeypatch.setattr(store, "ROWS_A_TASK", 250)
    monkeypatch.setattr(store, "REMOVED_TO_BROADCAST", 100)
    monkeypatch.setattr(database, "ROWS_IN_MEMORY", 100)


@pytest.fixture
def table(db, spark):
    assert db.execute("CREATE TABLE t (k INTEGER, v INTEGER)").ok
    assert db.load("t", spark.range(3000).selectExpr("id", "0")).ok
    return db


def plan(db):
    return db.dataframe("SELECT k, v FROM t")._jdf.queryExecution().optimizedPlan().toString()


def test_tasks_follow_the_rows(few_rows, table):
    assert table.execute("UPDATE t SET v = 1 WHERE k < 1000").affected == 1000
    assert table.execute("DELETE FROM t WHERE k >= 2000").affected == 1000
    found = table._current.tables["t"]
    assert (found.rows, found.removed) == (2000, 2000) and M.newest(Folder(table.spark, table.path)).tables["t"] == found
    # 4,000 versions read and 2,000 removals, 250 rows a task
    assert plan(table).count("RepartitionByExpression") == 2 and ", 24" in plan(table)
    assert table.execute("SELECT v, COUNT(*) AS n, MIN(k) AS a, MAX(k) AS b FROM t GROUP BY v ORDER BY v").rows == [(0, 1000, 1000, 1999), (1, 1000, 0, 999)]
    assert table.compact("t").ok and table._current.tables["t"].removed == 0
    assert table.execute("SELECT COUNT(*) FROM t").scalar() == 2000


def test_few_removals_do_not_move_the_table(few_rows, table):
    assert table.execute("DELETE FROM t WHERE k < 100").affected == 100
    assert "RepartitionByExpression" not in plan(table) and "strategy=broadcast" in plan(table)
    assert table.execute("SELECT COUNT(*) FROM t").scalar() == 2900


@pytest.mark.parametrize(("where", "code"), [("k > 500", StatusCode.ABORTED), ("k >= 501", None), ("k = 500", StatusCode.ABORTED), ("k = 501", None)])
def test_batches_and_ids_that_meet(few_rows, table, where, code):
    """A batch against a batch, or against few ids."""
    assert table.begin_transaction().ok
    assert table.execute("SELECT COUNT(*) FROM t").scalar() == 3000
    other = []
    thread = threading.Thread(target=lambda: other.append(table.execute("UPDATE t SET v = 2 WHERE k <= 500" if code is None or where == "k = 500" else "UPDATE t SET v = 2 WHERE k <= 600")))
    thread.start()
    thread.join()
    assert other[0].affected >= 501
    found = table.execute(f"UPDATE t SET v = 1 WHERE {where}")
    assert found.ok if code is None else found.code == code
    table.rollback()


def test_catalogs_without_the_number_of_removals_are_read():
    t = M.Table(1, (), ("a",), ("b",), 7, 3)
    body = M.json.loads(M.Manifest(tables={"t": t}).dumps())["body"].replace(', "removed": 3', "")
    text = M.json.dumps({"checksum": M.hashlib.sha256(body.encode()).hexdigest(), "body": body})
    assert "removed" not in body.replace("removals", "") and M.Manifest.loads(text).tables["t"].removed == 7
