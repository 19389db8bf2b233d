"""Seeded workloads that end in a crash somewhere in the commit protocol; what opens afterwards must be a committed state."""

import pytest

from orrery import faults
from orrery.database import Database
from orrery.sources import manifest as M
from orrery.sources.files import Folder

from .test_database import ok, rows


class Crash(Exception):
    pass


def crash(*_, **__):
    raise Crash


def workload(db, draws, oracle, n):
    """n statements that commit, and what they leave, by id."""
    for _ in range(n):
        kind, key, value = draws.choice(["insert", "update", "delete"]), draws.randrange(8), draws.randrange(100)
        if kind == "insert" and key not in oracle:
            ok(db, f"INSERT INTO t VALUES ({key}, {value})")
            oracle[key] = value
        elif kind == "update":
            ok(db, f"UPDATE t SET v = {value} WHERE id = {key}")
            oracle.update({key: value} if key in oracle else {})
        elif kind == "delete":
            ok(db, f"DELETE FROM t WHERE id = {key}")
            oracle.pop(key, None)


def last_statement(db):
    return db.execute("INSERT INTO t VALUES (100, 1), (101, 1)")


def newest(folder):
    return sorted(folder.glob("manifest-*.json"))[-1]


def no_checksums(folder):
    for p in folder.glob(".manifest-*.crc"):
        p.unlink()


def clean(db, folder, monkeypatch):
    assert last_statement(db).ok
    return True


def before_data(db, folder, monkeypatch):
    monkeypatch.setattr(db._store, "append", crash)
    assert not last_statement(db).ok


def after_data(db, folder, monkeypatch):
    db.before_publish = crash
    monkeypatch.setattr(db, "_discard", lambda txn: None)  # nothing is cleaned up after a crash
    assert not last_statement(db).ok


def within_publish(db, folder, monkeypatch):
    """The staged catalog is there, its rename is not."""
    publish = db._folder.publish

    def torn(name, text):
        (folder / f".{name}.staged").write_text(text[: len(text) // 2])
        raise Crash

    monkeypatch.setattr(db._folder, "publish", torn)
    monkeypatch.setattr(db, "_discard", lambda txn: None)
    assert not last_statement(db).ok and publish


def after_publish(db, folder, monkeypatch):
    """The commit is out; deleting the oldest version is not."""
    monkeypatch.setattr(db._folder, "delete", crash)
    assert last_statement(db).ok
    return True


def newest_torn(db, folder, monkeypatch):
    assert last_statement(db).ok
    newest(folder).write_text(newest(folder).read_text()[:-20])
    no_checksums(folder)


def newest_lost(db, folder, monkeypatch):
    assert last_statement(db).ok
    newest(folder).unlink()
    no_checksums(folder)


def within_vacuum(db, folder, monkeypatch):
    assert last_statement(db).ok and db.compact("t").ok
    for k in range(4):  # until no kept version needs the old batches
        ok(db, f"INSERT INTO t VALUES ({200 + k}, 0)", f"DELETE FROM t WHERE id = {200 + k}")
    delete, done = Folder.delete, []

    def once(self, name):
        if done:
            raise Crash
        done.append(name)
        delete(self, name)

    monkeypatch.setattr(Folder, "delete", once)
    with pytest.raises(Crash):
        db.vacuum()
    return True


def within_compaction(db, folder, monkeypatch):
    db.before_publish = crash
    assert not db.compact("t").ok
    return None


def in_transaction(db, folder, monkeypatch):
    """Several statements of an open transaction are lost whole."""
    assert db.begin_transaction().ok
    assert last_statement(db).ok
    ok(db, "DELETE FROM t WHERE id < 4")


SCHEDULES = [clean, before_data, after_data, within_publish, after_publish, newest_torn, newest_lost, within_vacuum, within_compaction, in_transaction]


@pytest.mark.parametrize("schedule", SCHEDULES, ids=lambda f: f.__name__)
def test_schedule(spark, tmp_path, schedule):
    folder = tmp_path / "db"
    oracle, draws = {}, faults.stream(1042, "workload")
    db = Database(f"file://{folder}", spark)
    ok(db, "CREATE TABLE t (id INTEGER, v INTEGER)", "INSERT INTO t VALUES (50, 0)")
    oracle[50] = 0
    workload(db, draws, oracle, 6)
    with pytest.MonkeyPatch.context() as patch:
        if schedule(db, folder, patch):
            oracle |= {100: 1, 101: 1}
    again = Database(f"file://{folder}", spark)  # the first is not closed: its process is gone
    assert again.is_open and dict(rows(again, "SELECT * FROM t")) == oracle
    workload(again, draws, oracle, 3)
    again.close()
    with Database(f"file://{folder}", spark) as db:
        assert dict(rows(db, "SELECT * FROM t")) == oracle


def test_control_without_recovery(spark, tmp_path):
    """A reader that takes every batch there is, not those of the catalog, sees what never committed: the schedules do test something."""
    folder = tmp_path / "db"
    db = Database(f"file://{folder}", spark)
    ok(db, "CREATE TABLE t (id INTEGER, v INTEGER)", "INSERT INTO t VALUES (1, 1)")
    with pytest.MonkeyPatch.context() as patch:
        after_data(db, folder, patch)
    every = spark.read.parquet(*(str(p) for p in (folder / "data").iterdir()))
    assert every.count() == 3 and rows(Database(f"file://{folder}", spark), "SELECT * FROM t") == [(1, 1)]


def test_streams_and_fates():
    first = faults.stream(7, "disk")
    a = [first.random() for _ in range(3)]
    other = faults.stream(7, "log")
    other.random()
    again = faults.stream(7, "disk")
    assert a == [again.random() for _ in range(3)] != [faults.stream(7, "log").random() for _ in range(3)]
    draws = faults.stream(1, "x")
    before = draws.getstate()
    assert not faults.happens(draws, 0) and draws.getstate() == before
    assert faults.happens(draws, 1000) and abs(sum(faults.happens(draws, 250) for _ in range(4000)) - 1000) < 150
    fates = [faults.fate(draws, 300, 200) for _ in range(4000)]
    assert [abs(fates.count(f) - n) < 200 for f, n in ((faults.Fate.LOST, 1200), (faults.Fate.TORN, 800), (faults.Fate.DURABLE, 2000))] == [True] * 3


def test_versions_kept(spark, tmp_path):
    with Database(f"file://{tmp_path}/db", spark) as db:
        ok(db, "CREATE TABLE t (id INTEGER, v INTEGER)", *(f"INSERT INTO t VALUES ({k}, 0)" for k in range(5)))
        assert [m.version for m in sorted(M.kept(db._folder), key=lambda m: m.version)] == [4, 5, 6]
