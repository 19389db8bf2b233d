import random
import threading
import time

import pytest

from orrery.database import Database
from orrery.status import StatusCode

from .test_database import ok, rows


def in_thread(f):
    """Run f in another thread (another session) and return its result or raise its error."""
    out = []

    def run():
        try:
            out.append((f(), None))
        except BaseException as e:  # noqa: BLE001
            out.append((None, e))

    t = threading.Thread(target=run)
    t.start()
    t.join(60)
    assert not t.is_alive()
    if out[0][1]:
        raise out[0][1]
    return out[0][0]


@pytest.fixture
def one(db):
    ok(db, "CREATE TABLE t (id INTEGER, v INTEGER)", "INSERT INTO t VALUES (1, 0), (2, 0)")
    return db


def test_rollback_and_own_writes(one):
    assert one.begin_transaction().ok and one.in_transaction()
    ok(one, "INSERT INTO t VALUES (3, 3)", "UPDATE t SET v = 9 WHERE id = 1", "DELETE FROM t WHERE id = 2", "UPDATE t SET v = v + 1 WHERE id = 1")
    assert sorted(rows(one, "SELECT * FROM t")) == [(1, 10), (3, 3)]
    assert in_thread(lambda: sorted(rows(one, "SELECT * FROM t"))) == [(1, 0), (2, 0)]
    assert one.rollback().ok and not one.in_transaction()
    assert sorted(rows(one, "SELECT * FROM t")) == [(1, 0), (2, 0)]


def test_commit_is_seen_by_later_snapshots_only(one):
    one.begin_transaction()
    assert len(rows(one, "SELECT * FROM t")) == 2
    in_thread(lambda: ok(one, "INSERT INTO t VALUES (3, 3)", "DELETE FROM t WHERE id = 1"))
    assert len(rows(one, "SELECT * FROM t WHERE id = 1")) == 1 and len(rows(one, "SELECT * FROM t")) == 2
    one.commit()
    assert sorted(r[0] for r in rows(one, "SELECT id FROM t")) == [2, 3]


def test_misuse(one):
    assert one.commit().code is StatusCode.INVALID_ARGUMENT
    assert one.rollback().code is StatusCode.INVALID_ARGUMENT
    one.begin_transaction()
    assert one.begin_transaction().code is StatusCode.INVALID_ARGUMENT
    assert one.rollback().ok


def test_failed_transaction_is_poisoned(one):
    one.begin_transaction()
    ok(one, "UPDATE t SET v = 5 WHERE id = 1")
    assert not one.execute("SELECT nothing FROM t").ok
    assert one.execute("SELECT * FROM t").code is StatusCode.ABORTED
    assert one.commit().code is StatusCode.ABORTED and not one.in_transaction()
    assert rows(one, "SELECT v FROM t WHERE id = 1") == [(0,)]


def test_conflict_with_a_later_commit(one):
    one.begin_transaction()
    in_thread(lambda: ok(one, "UPDATE t SET v = 111 WHERE id = 1"))
    assert one.execute("UPDATE t SET v = 222 WHERE id = 1").code is StatusCode.ABORTED
    one.rollback()
    assert rows(one, "SELECT v FROM t WHERE id = 1") == [(111,)]


def test_writers_of_different_rows_do_not_conflict(one):
    one.begin_transaction()
    ok(one, "UPDATE t SET v = 1 WHERE id = 1", "INSERT INTO t VALUES (7, 7)")
    in_thread(lambda: ok(one, "UPDATE t SET v = 2 WHERE id = 2", "INSERT INTO t VALUES (8, 8)"))
    assert one.commit().ok
    assert sorted(rows(one, "SELECT * FROM t")) == [(1, 1), (2, 2), (7, 7), (8, 8)]


def test_second_writer_waits_then_follows_a_rollback_or_loses_to_a_commit(one):
    for end, code in ((one.rollback, StatusCode.OK), (one.commit, StatusCode.ABORTED)):
        one.begin_transaction()
        ok(one, "UPDATE t SET v = v + 100 WHERE id = 1")
        found, second = [], threading.Thread(target=lambda: found.append(one.execute("UPDATE t SET v = v + 1 WHERE id = 1")))
        second.start()
        time.sleep(1.5)
        assert not found  # it waits for the row
        assert end().ok
        second.join(30)
        assert found[0].code is code
    assert rows(one, "SELECT v FROM t WHERE id = 1") == [(101,)]


def test_deadlock_ends_with_the_youngest(one):
    one.begin_transaction()
    ok(one, "UPDATE t SET v = 1 WHERE id = 1")
    ready, go, found = threading.Event(), threading.Event(), []

    def other():
        one.begin_transaction()
        ok(one, "UPDATE t SET v = 2 WHERE id = 2")
        ready.set()
        go.wait(30)
        found.append(one.execute("UPDATE t SET v = 2 WHERE id = 1").code)
        one.rollback()

    t = threading.Thread(target=other)
    t.start()
    ready.wait(30)
    go.set()
    time.sleep(1)
    mine = one.execute("UPDATE t SET v = 1 WHERE id = 2")
    t.join(30)
    assert mine.ok and found == [StatusCode.ABORTED]
    assert one.commit().ok
    assert sorted(rows(one, "SELECT * FROM t")) == [(1, 1), (2, 1)]


def test_lock_timeout(one, monkeypatch):
    monkeypatch.setattr("orrery.transactions.LOCK_TIMEOUT_SECONDS", 0.3)
    one.begin_transaction()
    ok(one, "DELETE FROM t WHERE id = 1")
    assert in_thread(lambda: one.execute("DELETE FROM t WHERE id = 1").code) is StatusCode.TIMEOUT
    one.rollback()


def test_many_rows_conflict_by_row(one, monkeypatch):
    """Statements whose rows are not held in memory: disjoint ones commit, a shared row makes the later one wait or abort."""
    monkeypatch.setattr("orrery.database.ROWS_IN_MEMORY", 1)
    ok(one, "INSERT INTO t VALUES (3, 0), (4, 0)")
    one.begin_transaction()
    ok(one, "UPDATE t SET v = 1 WHERE id < 3")
    in_thread(lambda: ok(one, "UPDATE t SET v = 2 WHERE id > 2"))  # while the other's rows are locked
    assert one.commit().ok
    assert sorted(rows(one, "SELECT * FROM t")) == [(1, 1), (2, 1), (3, 2), (4, 2)]
    one.begin_transaction()
    in_thread(lambda: ok(one, "UPDATE t SET v = 5"))
    assert one.execute("DELETE FROM t WHERE id = 2").code is StatusCode.ABORTED
    one.rollback()
    monkeypatch.setattr("orrery.transactions.LOCK_TIMEOUT_SECONDS", 2)
    one.begin_transaction()
    ok(one, "UPDATE t SET v = 7 WHERE id < 4")
    assert in_thread(lambda: one.execute("DELETE FROM t WHERE id > 2").code) is StatusCode.TIMEOUT
    assert one.rollback().ok
    assert sorted(rows(one, "SELECT v FROM t")) == [(5,)] * 4


def test_isolation_levels(one):
    from orrery.transactions import IsolationLevel

    for level in IsolationLevel:
        assert one.begin_transaction(level).ok
        assert len(rows(one, "SELECT * FROM t")) == 2
        assert one.rollback().ok
    assert [level.name for level in IsolationLevel] == ["READ_UNCOMMITTED", "READ_COMMITTED", "REPEATABLE_READ", "SERIALIZABLE"]


def test_abandoned_threads_are_rolled_back(one):
    def leave():
        one.begin_transaction()
        ok(one, "UPDATE t SET v = 77")

    in_thread(leave)
    ok(one, "UPDATE t SET v = 1")
    assert sorted(rows(one, "SELECT v FROM t")) == [(1,), (1,)]


def test_unique_key_from_two_transactions(one):
    ok(one, "CREATE UNIQUE INDEX k ON t (id)")
    one.begin_transaction()
    ok(one, "INSERT INTO t VALUES (9, 1)")
    in_thread(lambda: ok(one, "INSERT INTO t VALUES (9, 2)"))
    assert one.commit().code is StatusCode.ABORTED
    assert rows(one, "SELECT v FROM t WHERE id = 9") == [(2,)]


def test_dropped_meanwhile(one):
    one.begin_transaction()
    ok(one, "INSERT INTO t VALUES (3, 3)")
    in_thread(lambda: ok(one, "DROP TABLE t"))
    assert len(rows(one, "SELECT * FROM t")) == 3  # the snapshot is still there
    assert one.commit().code is StatusCode.ABORTED


class Crash(Exception):
    pass


def crash():
    raise Crash


@pytest.mark.parametrize("seed", range(4))
def test_seeded_workload_with_crashes(spark, tmp_path, seed):
    """Random inserts, updates and deletes against a dict; commits may crash before they are published; after each crash the database is
    opened anew and must hold exactly what was committed."""
    draw, path = random.Random(seed), f"file://{tmp_path}/db"
    db, committed = Database(path, spark), {}
    ok(db, "CREATE TABLE t (id INTEGER, name VARCHAR(64))")
    next_id, crashes = 1, 0
    for _ in range(5):
        db.begin_transaction()
        state = dict(committed)
        for _ in range(draw.randint(1, 3)):
            kind = draw.random()
            if kind < 0.55 or not state:
                ok(db, f"INSERT INTO t VALUES ({next_id}, 'n{next_id}')")
                state[next_id] = f"n{next_id}"
                next_id += 1
            elif kind < 0.8:
                k = draw.choice(sorted(state))
                ok(db, f"UPDATE t SET name = 'u{next_id}' WHERE id = {k}")
                state[k] = f"u{next_id}"
            else:
                k = draw.choice(sorted(state))
                ok(db, f"DELETE FROM t WHERE id = {k}")
                del state[k]
        fate = draw.random()
        if fate < 0.3:
            db.before_publish = crash
            assert not db.commit().ok
            crashes += 1
            db = Database(path, spark)  # the old one is gone without a close
        elif fate < 0.5:
            assert db.rollback().ok
        else:
            assert db.commit().ok
            committed = state
        assert dict(rows(db, "SELECT id, name FROM t")) == committed
    db = Database(path, spark)
    assert dict(rows(db, "SELECT id, name FROM t")) == committed
    db.vacuum()
    assert dict(rows(db, "SELECT id, name FROM t")) == committed


def test_torn_manifest_falls_back(spark, tmp_path):
    path = tmp_path / "db"
    with Database(f"file://{path}", spark) as db:
        ok(db, "CREATE TABLE t (id INTEGER)", "INSERT INTO t VALUES (1)")
    newest = sorted(path.glob("manifest-*.json"))[-1]
    text = newest.read_text()
    (path / "manifest-000000000099.json").write_text(text[: len(text) // 2])
    with Database(f"file://{path}", spark) as db:
        assert rows(db, "SELECT * FROM t") == [(1,)]
        ok(db, "INSERT INTO t VALUES (2)")


def test_garbage_manifest_opens_empty(spark, tmp_path):
    (tmp_path / "db").mkdir()
    (tmp_path / "db" / "manifest-000000000001.json").write_text("{}")
    with Database(f"file://{tmp_path}/db", spark) as db:
        assert db.table_names() == []


def test_damaged_pages_are_reported(spark, tmp_path):
    with Database(f"file://{tmp_path}/db", spark) as db:
        ok(db, "CREATE TABLE t (v VARCHAR(99))", f"INSERT INTO t VALUES ('{'needle' * 9}')")
        (part,) = (tmp_path / "db" / "data").glob("*/part-*.parquet")
        data = bytearray(part.read_bytes())
        data[data.find(b"needle") + 3] ^= 1
        part.write_bytes(bytes(data))
        (part.parent / f".{part.name}.crc").unlink()
        assert db.execute("SELECT v FROM t").code is StatusCode.CORRUPTION
