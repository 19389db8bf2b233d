import pytest

from orrery.database import Database, statements
from orrery.status import StatusCode


def ok(db, *texts):
    for text in texts:
        found = db.execute(text)
        assert found.ok, (text, found.message)
    return found


def rows(db, text):
    return ok(db, text).rows


@pytest.fixture
def users(db):
    ok(db, "CREATE TABLE users (id INTEGER, name VARCHAR(100), age INTEGER)", "INSERT INTO users VALUES (1, 'Alice', 25), (2, 'Bob', 30), (3, 'Charlie', 35)")
    return db


def test_select(users):
    assert sorted(rows(users, "SELECT * FROM users WHERE age > 28")) == [(2, "Bob", 30), (3, "Charlie", 35)]
    found = ok(users, "SELECT name, age FROM users WHERE 1 = 0")
    assert found.columns == ["name", "age"] and found.rows == []


def test_order_by_hidden_column_and_limits(users):
    assert rows(users, "SELECT name FROM users ORDER BY age DESC") == [("Charlie",), ("Bob",), ("Alice",)]
    assert rows(users, "SELECT name FROM users ORDER BY id LIMIT 1 OFFSET 1") == [("Bob",)]
    assert rows(users, "SELECT name FROM users LIMIT 0") == []
    assert rows(users, "SELECT name FROM users ORDER BY id LIMIT 5 OFFSET 9") == []
    assert rows(users, "SELECT id AS x FROM users ORDER BY id DESC LIMIT 1") == [(3,)]
    assert users.execute("SELECT name FROM users ORDER BY nothing").code is StatusCode.INVALID_ARGUMENT


def test_changes(users):
    assert ok(users, "UPDATE users SET age = 99, name = 'B' WHERE id = 2").affected == 1
    assert ok(users, "DELETE FROM users WHERE id = 1").affected == 1
    assert ok(users, "DELETE FROM users WHERE id = 77").affected == 0
    assert sorted(rows(users, "SELECT * FROM users")) == [(2, "B", 99), (3, "Charlie", 35)]
    assert ok(users, "UPDATE users SET id = age, age = id").affected == 2  # right sides see the old row
    assert sorted(rows(users, "SELECT id, age FROM users")) == [(35, 3), (99, 2)]


def test_insert_forms(users):
    assert ok(users, "INSERT INTO users (name, id) VALUES ('D', 4)").affected == 1
    assert rows(users, "SELECT age FROM users WHERE id = 4") == [(None,)]
    assert users.execute("INSERT INTO users VALUES (1, 'x')").code is StatusCode.INVALID_ARGUMENT
    assert users.execute("INSERT INTO users (id, id) VALUES (1, 2)").code is StatusCode.INVALID_ARGUMENT
    assert users.execute("INSERT INTO users (nope) VALUES (1)").code is StatusCode.INVALID_ARGUMENT


def test_ill_typed_statements_change_nothing(users):
    for text in ("INSERT INTO users VALUES ('x', 'y', 1)", "INSERT INTO users VALUES (1, 2, 3)", "INSERT INTO users VALUES (1.5, 'x', 1)", "UPDATE users SET age = name", "UPDATE users SET age = name * age", "UPDATE users SET age = 1.5", "SELECT name + 1 FROM users", "SELECT SUM(name) FROM users"):
        assert users.execute(text).code is StatusCode.INVALID_ARGUMENT, text
    assert sorted(rows(users, "SELECT * FROM users")) == [(1, "Alice", 25), (2, "Bob", 30), (3, "Charlie", 35)]


def test_types_round_trip(db):
    ok(db, "CREATE TABLE n (s SMALLINT, t TINYINT, f FLOAT, m DECIMAL(10,2), w TIMESTAMP, b BOOLEAN)", "INSERT INTO n VALUES (5, 300, 2.5, 42, 1700000000, TRUE), (-1, -129, 1, 19.99, NULL, NULL)")
    assert sorted(rows(db, "SELECT * FROM n")) == [(-1, 127, 1.0, 19.99, None, None), (5, 44, 2.5, 42.0, 1700000000, True)]
    assert rows(db, "SELECT m * 2 AS x FROM n WHERE s = -1") == [(39.98,)]
    ok(db, "UPDATE n SET m = 5, s = 70000, f = 0.5 WHERE s = 5")
    assert rows(db, "SELECT s, f, m FROM n WHERE t = 44") == [(4464, 0.5, 5.0)]
    assert db.execute("SELECT w + 1 FROM n").code is StatusCode.INVALID_ARGUMENT
    assert rows(db, "SELECT t FROM n WHERE w > 5") == [(44,)]


def test_joins(db):
    ok(db, "CREATE TABLE u (user_id INTEGER, name VARCHAR(9))", "INSERT INTO u VALUES (1, 'Alice'), (2, 'Bob'), (3, 'Charlie'), (NULL, 'Nobody')")
    ok(db, "CREATE TABLE o (order_id BIGINT, user_id BIGINT, amount INTEGER)", "INSERT INTO o VALUES (101, 1, 100), (102, 1, 200), (103, 2, 150), (104, 99, 50), (105, NULL, 5)")
    on = "ON u.user_id = o.user_id"
    inner = [("Alice", 101), ("Alice", 102), ("Bob", 103)]
    assert sorted(rows(db, f"SELECT name, order_id FROM u JOIN o {on}")) == inner
    assert set(rows(db, f"SELECT name, order_id FROM u LEFT JOIN o {on}")) == {*inner, ("Charlie", None), ("Nobody", None)}
    assert set(rows(db, f"SELECT name, order_id FROM u RIGHT JOIN o {on}")) == {*inner, (None, 104), (None, 105)}
    assert len(rows(db, "SELECT * FROM u CROSS JOIN o")) == 20
    assert ok(db, f"SELECT * FROM u JOIN o {on}").columns == ["user_id", "name", "order_id", "user_id", "amount"]
    assert sorted(rows(db, "SELECT a.name, b.name FROM u a JOIN u b ON a.user_id < b.user_id")) == [("Alice", "Bob"), ("Alice", "Charlie"), ("Bob", "Charlie")]
    # an unqualified name that fits both sides is the first one's
    assert rows(db, f"SELECT user_id FROM u RIGHT JOIN o {on} WHERE order_id = 104") == [(None,)]
    assert db.execute("SELECT zzz.name FROM u").code is StatusCode.INVALID_ARGUMENT
    assert db.execute("SELECT * FROM u JOIN u ON TRUE").code is StatusCode.INVALID_ARGUMENT


def test_grouping(db):
    ok(db, "CREATE TABLE emp (dept INTEGER, sal INTEGER)", "INSERT INTO emp VALUES (10, 100), (10, 200), (20, 300), (20, 50), (20, 120)")
    found = ok(db, "SELECT COUNT(*), dept, SUM(sal), MIN(sal), MAX(sal), AVG(sal) AS a FROM emp GROUP BY dept ORDER BY dept DESC")
    assert found.columns == ["count(*)", "dept", "sum(sal)", "min(sal)", "max(sal)", "a"]
    assert found.rows == [(3, 20, 470, 50, 300, 470 / 3), (2, 10, 300, 100, 200, 150.0)]
    assert sorted(rows(db, "SELECT dept FROM emp GROUP BY dept")) == [(10,), (20,)]
    assert rows(db, "SELECT COUNT(*) AS n FROM emp GROUP BY emp.dept ORDER BY dept") == [(2,), (3,)]


def test_definitions(db):
    ok(db, "CREATE TABLE t (a INTEGER)")
    assert db.execute("CREATE TABLE t (b INTEGER)").code is StatusCode.ALREADY_EXISTS
    assert db.execute("SELECT * FROM T").code is StatusCode.NOT_FOUND  # names are case-sensitive
    assert db.execute("SELECT A FROM t").code is StatusCode.INVALID_ARGUMENT
    ok(db, "CREATE INDEX i ON t (a)")
    assert db.execute("CREATE INDEX i ON t (a)").code is StatusCode.ALREADY_EXISTS
    assert db.execute("CREATE INDEX j ON t (b)").code is StatusCode.INVALID_ARGUMENT
    assert db.execute("CREATE INDEX j ON t (a, a)").code is StatusCode.NOT_SUPPORTED
    ok(db, "DROP INDEX i ON t")
    assert db.execute("DROP INDEX i").code is StatusCode.NOT_FOUND
    ok(db, "DROP TABLE t")
    assert db.execute("DROP TABLE t").code is StatusCode.NOT_FOUND


def test_index_never_changes_results(db):
    ok(db, "CREATE TABLE t (k INTEGER, name VARCHAR(9))", "INSERT INTO t VALUES (0, 'zero'), (NULL, 'null'), (7, 'a'), (7, 'b')")
    ok(db, "CREATE INDEX i ON t (k)", "CREATE INDEX n ON t (name)")
    assert rows(db, "SELECT name FROM t WHERE k = 0") == [("zero",)]
    assert sorted(rows(db, "SELECT name FROM t WHERE k = 7")) == [("a",), ("b",)]
    ok(db, "UPDATE t SET k = 8 WHERE name = 'a'", "DELETE FROM t WHERE k = 0")
    assert rows(db, "SELECT name FROM t WHERE k >= 7 AND k <= 7") == [("b",)]


def test_unique_index(db):
    ok(db, "CREATE TABLE t (k INTEGER, v INTEGER)", "INSERT INTO t VALUES (1, 1), (2, 1), (NULL, 2), (NULL, 3)")
    assert db.execute("CREATE UNIQUE INDEX v ON t (v)").code is StatusCode.ALREADY_EXISTS
    ok(db, "CREATE UNIQUE INDEX k ON t (k)")
    assert db.execute("INSERT INTO t VALUES (2, 9)").code is StatusCode.ALREADY_EXISTS
    assert db.execute("INSERT INTO t VALUES (5, 9), (5, 9)").code is StatusCode.ALREADY_EXISTS
    assert db.execute("UPDATE t SET k = 1").code is StatusCode.ALREADY_EXISTS
    ok(db, "INSERT INTO t VALUES (NULL, 9), (3, 9)", "UPDATE t SET k = k + 1")
    assert sorted(r[0] for r in rows(db, "SELECT k FROM t WHERE k IS NOT NULL")) == [2, 3, 4]


def test_explain(users):
    lines = [r[0] for r in ok(users, "EXPLAIN ANALYZE SELECT name FROM users u WHERE age > 3 ORDER BY age LIMIT 2").rows]
    assert "Sequential Scan on users" in lines[0] and "cost=" in lines[0]
    assert "Limit: 2" in lines and any(x.startswith("Estimated Rows") for x in lines)
    joined = ok(users, "EXPLAIN SELECT COUNT(*) FROM users a CROSS JOIN users b").rows
    assert any("Nested Loop Join" in r[0] for r in joined)
    ok(users, "CREATE TABLE big (id INTEGER)", "CREATE UNIQUE INDEX i ON big (id)")
    assert users.load("big", users.spark.range(20_000)).affected == 20_000
    assert "Index Scan (Point Lookup)" in ok(users, "EXPLAIN SELECT id FROM big WHERE id = 5").rows[0][0]
    assert any("Hash Join" in r[0] for r in ok(users, "EXPLAIN SELECT * FROM big a JOIN big b ON a.id = b.id").rows)
    assert users.execute("EXPLAIN DELETE FROM users").code is StatusCode.INVALID_ARGUMENT


def test_reopen_compact_vacuum(spark, tmp_path):
    path = f"file://{tmp_path}/kept"
    with Database(path, spark) as db:
        ok(db, "CREATE TABLE t (a INTEGER)", "INSERT INTO t VALUES (1), (2), (3)", "DELETE FROM t WHERE a = 2", "UPDATE t SET a = 30 WHERE a = 3")
        assert db.compact("t").ok
        for k in range(3):  # until no kept version of the catalog refers to the old batches
            ok(db, f"INSERT INTO t VALUES ({100 + k})", f"DELETE FROM t WHERE a = {100 + k}")
        assert db.vacuum() > 0
        assert sorted(rows(db, "SELECT a FROM t")) == [(1,), (30,)]
        ok(db, "UPDATE t SET a = 31 WHERE a = 30")
    with Database(path, spark) as db:
        assert sorted(rows(db, "SELECT a FROM t")) == [(1,), (31,)]
        ok(db, "INSERT INTO t VALUES (4)")
    assert not Database(path, spark, error_if_exists=True).is_open
    assert not Database(f"file://{tmp_path}/absent", spark, create_if_missing=False).is_open
    assert Database(path, spark, page_size=8192).execute("SELECT * FROM t").code is StatusCode.INVALID_ARGUMENT
    db = Database(path, spark)
    db.close()
    assert db.execute("SELECT * FROM t").code is StatusCode.ERROR


def test_strict_mode(spark, tmp_path):
    with Database(f"file://{tmp_path}/strict", spark, strict_mode=True) as db:
        ok(db, "CREATE TABLE t (id INTEGER, v VARCHAR(16), w TIMESTAMP)")
        for values in ("('oops', 'x', 1)", "(1, 2, 3)", "(3000000000, 'x', 1)"):
            assert db.execute(f"INSERT INTO t VALUES {values}").code is StatusCode.INVALID_ARGUMENT
        ok(db, "INSERT INTO t VALUES (1, 'ok', 5)")


def test_lazy_results(users):
    assert sorted(tuple(r) for r in users.dataframe("SELECT id, age FROM users WHERE age > 28").collect()) == [(2, 30), (3, 35)]


def test_script_splitting():
    assert list(statements("SELECT ';' FROM t; -- a; b\nSELECT b FROM u")) == ["SELECT ';' FROM t;", "-- a; b\nSELECT b FROM u"]


def test_many_small_inserts_are_merged(db):
    """Batches of literal rows are merged level by level; removals and open snapshots are not disturbed."""
    ok(db, "CREATE TABLE t (a INTEGER)")
    for k in range(20):
        ok(db, f"INSERT INTO t VALUES ({k})")
        if k == 5:
            ok(db, "DELETE FROM t WHERE a = 2")
    assert sorted(r[0] for r in rows(db, "SELECT a FROM t")) == [k for k in range(20) if k != 2]
    assert len(db._current.tables["t"].files) <= 6
    ok(db, "UPDATE t SET a = a + 100 WHERE a < 4", "DELETE FROM t WHERE a = 19")
    assert sorted(r[0] for r in rows(db, "SELECT a FROM t")) == [*range(4, 19), 100, 101, 103]


def test_row_ids_last_over_many_loads(db):
    """A load gives back the row ids it had room for, and a counter near its end still serves."""
    ok(db, "CREATE TABLE t (a BIGINT)")
    for _ in range(3):
        before = db._next_rid
        assert db.load("t", db.spark.range(100).repartition(2)).affected == 100
        assert db._next_rid - before <= 16 << 33
    db._next_rid = 2**62
    assert db.load("t", db.spark.range(10)).affected == 10
    ok(db, "INSERT INTO t VALUES (-1)", "UPDATE t SET a = a + 1 WHERE a = 0")
    assert rows(db, "SELECT COUNT(*) FROM t") == [(311,)]


def test_limits_beyond_32_bits(db, monkeypatch):
    ok(db, "CREATE TABLE t (a INTEGER)", "INSERT INTO t VALUES (1), (2), (3)")
    assert len(rows(db, f"SELECT a FROM t LIMIT {2**40}")) == 3
    assert rows(db, f"SELECT a FROM t LIMIT 5 OFFSET {2**40}") == []
    assert rows(db, f"SELECT a FROM t ORDER BY a LIMIT {2**63 - 1} OFFSET 2") == [(3,)]


def test_a_damaged_newest_version_leaves_a_whole_older_one(spark, tmp_path):
    path = f"{tmp_path}/torn"
    with Database(f"file://{path}", spark) as db:
        ok(db, "CREATE TABLE t (a INTEGER)", "INSERT INTO t VALUES (1), (2)", "UPDATE t SET a = 20 WHERE a = 2")
        assert db.compact("t").ok  # the version before refers to batches that the newest does not
    newest = sorted(p for p in tmp_path.joinpath("torn").iterdir() if p.name.startswith("manifest-"))[-1]
    newest.write_text(newest.read_text()[:-9])
    for crc in tmp_path.joinpath("torn").glob(".manifest-*.crc"):
        crc.unlink()
    with Database(f"file://{path}", spark) as db:
        assert sorted(rows(db, "SELECT a FROM t")) == [(1,), (20,)]
