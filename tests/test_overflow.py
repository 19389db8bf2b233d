"""Integer arithmetic at the edges of 64 bits: exact or NULL, without an exception a row in short expressions, and long ones do not multiply."""

import itertools

import pytest

from orrery.parquet_sql import select

MAX, MIN = 2**63 - 1, -(2**63)
EDGES = [None, 0, 1, -1, 2, -2, 3, -7, 2**31, -(2**31), 2**32, 3037000499, 3037000500, -3037000500, MAX // 2, MAX // 2 + 1, MIN // 2, MIN // 2 - 1, MAX // 3, MIN // 3, MAX - 1, MAX, MIN, MIN + 1]


@pytest.fixture(params=["true", "false"])
def session(spark, request):
    found = spark.newSession()
    found.conf.set("spark.sql.ansi.enabled", request.param)
    return found


def kept(x):
    return x if x is not None and MIN <= x <= MAX else None


def wanted(op, a, b):
    if a is None or b is None or (op == "/" and b == 0):
        return None
    if op == "/":
        return kept(abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1))
    return kept({"+": a + b, "-": a - b, "*": a * b}[op])


def test_columns(session):
    t = session.createDataFrame([(a, b) for a, b in itertools.product(EDGES, EDGES)], "a long, b long").coalesce(2)
    got = select("SELECT a, b, a + b AS p, a - b AS m, a * b AS t, a / b AS q, -a AS n FROM t", {"t": t}).collect()
    assert len(got) == len(EDGES) ** 2
    for a, b, *found in got:
        assert found == [*(wanted(op, a, b) for op in "+-*/"), wanted("-", 0, a)], (a, b)


@pytest.mark.parametrize("b", [0, 1, -1, 2, -2, -7, 2**55, MAX, -MAX])
def test_literals(session, b):
    t = session.createDataFrame([(a,) for a in EDGES], "a long").coalesce(2)
    for a, *found in select(f"SELECT a, a + {b} AS p, a - {b} AS m, a * {b} AS t, {b} * a AS u, {b} + a AS v, {b} - a AS w FROM t", {"t": t}).collect():
        assert found == [*(wanted(op, a, b) for op in "+-*"), wanted("*", b, a), wanted("+", b, a), wanted("-", b, a)], a


def test_constants(session):
    found = select(f"SELECT {MAX} + 1 AS a, 0 - {MAX} - 2 AS b, {MAX} * 2 AS c, {MAX} + 0 AS d, 1 + NULL AS e FROM t", {"t": session.range(1)}).first()
    assert tuple(found) == (None, None, None, MAX, None)


def test_no_exception_a_row(session):
    plan = select("SELECT id + 1 AS a, id - 1 AS b, id * 3 AS c, id * id AS d, -id AS e FROM t", {"t": session.range(5)})._jdf.queryExecution().optimizedPlan().toString()
    assert "try_" not in plan.lower()


@pytest.mark.parametrize("text", [" + ".join(["id"] * 60), " - ".join(["id"] * 60), "id" + " + (id" * 25 + ")" * 25, " * ".join(["id"] * 40)])
def test_long_chains(session, text):
    found = select(f"SELECT id, {text} AS v FROM t WHERE {text} IS NULL OR TRUE", {"t": session.range(4)}).collect()
    for x, v in found:
        assert v == (kept(eval(text, {"id": x})))


def test_overflow_inside_a_chain_stays(session):
    chain = " + ".join(["1"] * 20)
    assert select(f"SELECT id + {MAX} + {chain} - {MAX} AS v FROM t", {"t": session.range(2)}).collect() == [(None,), (None,)]
