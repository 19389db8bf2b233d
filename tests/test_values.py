"""Value semantics of expressions and aggregates, under both ANSI settings."""

import math

import pytest

from orrery.parquet_sql import select
from orrery.status import SqlError

MAX, MIN = 2**63 - 1, -(2**63)


@pytest.fixture(params=["true", "false"])
def session(spark, request):
    found = spark.newSession()
    found.conf.set("spark.sql.ansi.enabled", request.param)
    found.conf.set("spark.sql.shuffle.partitions", "2")
    return found


@pytest.fixture
def value(session):
    one = session.createDataFrame([(1, "abc", True, 2.5, None, MAX, MIN, 0)], "i int, s string, b boolean, d double, n int, big long, small long, z int")

    def run(expression, table=one):
        return select(f"SELECT {expression} AS v FROM t", {"t": table}).first()[0]

    return run


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1 + 2", 3), ("big + 1", None), ("small - 1", None), ("big * big", None), ("1000 * 1000", 1_000_000), ("small / -1", None), ("-7 / 2", -3), ("7 / -2", -3), ("7 / 2", 3), ("1 / z", None), ("d / 0", None), ("d / 0.0", None),
        ("7 / 2.0", 3.5), ("-i", -1), ("-small", None), ("n + 1", None), ("i + NULL", None), ("d * 2", 5.0), ("i = 1.0", True), ("s = 'abc'", True), ("s < 'abd'", True), ("b = TRUE", True), ("FALSE < TRUE", True), ("n = 1", None), ("NULL = NULL", None),
        ("n IS NULL", True), ("n IS NOT NULL", False), ("(n = 1) OR TRUE", True), ("(n = 1) AND FALSE", False), ("(n = 1) AND TRUE", None), ("NOT (n = 1)", None), ("NOT FALSE", True), ("big = 9223372036854775807", True), ("big - 1 = big", False),
    ],
)
def test_expressions(value, text, expected):
    assert value(text) == expected


@pytest.mark.parametrize("text", ["s + 1", "5 + 'abc'", "b * 2", "s = 1", "'1' = 1", "b = 1", "i AND b", "NOT i", "-s", "NOT i = 1"])
def test_ill_typed(value, text):
    with pytest.raises(SqlError):
        value(text)


def test_condition_must_be_boolean(session):
    with pytest.raises(SqlError):
        select("SELECT i FROM t WHERE i", {"t": session.range(3).withColumnRenamed("id", "i")})


def agg(session, rows, schema, items):
    return tuple(select(f"SELECT {items} FROM t", {"t": session.createDataFrame(rows, schema)}).first())


def test_big_integer_sum_and_average(session):
    rows = [(9007199254740993,), (9007199254740994,)]
    assert agg(session, rows, "v long", "SUM(v) AS s, AVG(v) AS a") == (18014398509481987, 9007199254740994.0)


def test_sum_wraps(session):
    assert agg(session, [(MAX,), (1,)], "v long", "SUM(v) AS s") == (MIN,)


def test_average_of_integers(session):
    assert agg(session, [(300,), (50,), (120,)], "v int", "AVG(v) AS a, SUM(v) AS s") == (470 / 3, 470)


def test_empty(session):
    assert agg(session, [], "x int", "COUNT(*) AS c, COUNT(x) AS n, SUM(x) AS s, AVG(x) AS a, MIN(x) AS lo, MAX(x) AS hi") == (0, 0, None, None, None, None)


def test_min_max_are_exact_and_by_bytes(session):
    assert agg(session, [(MAX, "b", True), (MAX - 1, "a", False), (None, None, None)], "v long, s string, b boolean", "MIN(v) AS a, MAX(v) AS b, MIN(s) AS c, MAX(b) AS d") == (MAX - 1, MAX, "a", True)


def test_nan_groups_and_sorts_largest(session):
    t = session.createDataFrame([(math.nan,), (math.nan,), (1.0,), (None,)], "x double")
    rows = select("SELECT x, COUNT(*) AS n FROM t GROUP BY x ORDER BY x", {"t": t}).collect()
    assert [(r[0] if r[0] is None or r[0] == r[0] else "nan", r[1]) for r in rows] == [(None, 1), (1.0, 1), ("nan", 2)]


@pytest.mark.parametrize("items", ["SUM(s)", "AVG(s)", "SUM(b)", "SUM(i * 2)", "i, COUNT(*)", "*", "i + 1, COUNT(*)"])
def test_bad_aggregates(session, items):
    t = session.createDataFrame([(1, "a", True)], "i int, s string, b boolean")
    text = f"SELECT {items} FROM t" + (" GROUP BY s" if items == "*" else "")
    with pytest.raises(SqlError):
        select(text, {"t": t}).collect()
