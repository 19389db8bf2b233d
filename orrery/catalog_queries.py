"""Queries over the star schema, one or more an operator, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery import analytics
from orrery.database import Database
from orrery.operators import relational as R
from orrery.parquet_sql import select
from orrery.sources import run_logs
from orrery.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

MAX = 2**63 - 1
#: Columns that hold nulls, made alike here and in the oracle: the data itself has none.
_NULLED = "(SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderstatus FROM orders)"


class Tables(Mapping):
    """The Parquet tables of a folder, read when named; nulled is orders with nulls."""

    names = "region nation customer supplier part orders lineitem events nulled lineitem_keys".split()

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        if name == "lineitem_keys":
            return self["lineitem"].select(F.col("l_orderkey").alias("k"), F.lit(0).alias("v"))
        if name != "nulled":
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        key, orders = F.col("o_orderkey"), self["orders"]
        return orders.select("o_orderkey", F.when(key % 7 != 0, F.col("o_custkey")).alias("k"), F.when(key % 5 != 0, F.col("o_totalprice")).alias("price"), "o_orderstatus")

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


def _sql(name: str, text: str, oracle: str | None = None, rounded: dict[str, int] | None = None) -> None:
    """Register a statement of the dialect. The oracle is the same text unless given; rounded columns are sums whose last bits depend on order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = select(text, Tables(spark, sf_dir))
        return found.withColumns({c: F.round(c, n) for c, n in (rounded or {}).items()})

    QUERIES[name] = run
    ORACLE_SQL[name] = (oracle or text).replace("FROM nulled", f"FROM {_NULLED}")


def _made(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


_FLAGSHIP = "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_linenumber) AS s, AVG(l_quantity) AS aq FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(_FLAGSHIP, Tables(spark, sf_dir))


# Scans, filters, projection
_sql("scan_all", "SELECT * FROM region")
_sql("point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
_sql("range_scan", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 180")
_sql("constant_predicate", "SELECT r_name FROM region WHERE 1 = 0")
_sql("column_projection", "SELECT n_name, n_regionkey FROM nation")
_sql("pushed_filter", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45.0 AND l_returnflag = 'R'")
_sql("filter_3vl", "SELECT o_orderkey FROM nulled WHERE k > 700 OR price < 50000.0")
_sql("is_null", "SELECT o_orderkey, price FROM nulled WHERE k IS NULL AND price IS NOT NULL")
_sql("not_predicate", "SELECT o_orderkey FROM nulled WHERE NOT (k > 700)")
_sql("bool_logic", "SELECT o_orderkey, k > 700 AND price > 1000.0 AS both_hold, k > 700 OR price > 1000.0 AS one_holds FROM nulled")
_sql("string_compare", "SELECT c_custkey FROM customer WHERE c_mktsegment >= 'BUILDING' AND c_mktsegment < 'HOUSEHOLD'")
_sql("project_arith", "SELECT l_orderkey, l_linenumber, l_orderkey * 3 + l_linenumber - 1 AS v FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey * 3 + CAST(l_linenumber AS BIGINT) - 1 AS BIGINT) AS v FROM lineitem")
_sql("project_double", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem", rounded={"net": 4})
ORACLE_SQL["project_double"] = "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem"
_sql("int_division", "SELECT l_orderkey, l_linenumber, (l_orderkey - 900) / (l_linenumber - 3) AS q FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN NULL ELSE (l_orderkey - 900) // (CAST(l_linenumber AS BIGINT) - 3) END AS q FROM lineitem")
_sql("overflow_null", f"SELECT o_orderkey, o_orderkey + {MAX - 500} AS a, o_orderkey * {2**55} AS m, 0 - {MAX} - o_orderkey AS s FROM orders", f"SELECT o_orderkey, TRY(o_orderkey + {MAX - 500}) AS a, TRY(o_orderkey * {2**55}) AS m, TRY(-{MAX} - o_orderkey) AS s FROM orders")
_sql("float_div_zero", "SELECT l_orderkey, l_linenumber, l_quantity / l_discount AS r FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(l_discount, 0), 6) AS r FROM lineitem", {"r": 6})
_sql("unary_minus", "SELECT n_nationkey, -n_nationkey AS neg, -(n_regionkey + 1) AS neg2 FROM nation", "SELECT n_nationkey, CAST(-n_nationkey AS BIGINT) AS neg, CAST(-(n_regionkey + 1) AS BIGINT) AS neg2 FROM nation")

# Joins
_sql("join_inner", "SELECT c.c_name AS customer, n.n_name AS nation FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
_sql("join_left", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 2")
_sql("join_right", "SELECT n_name, r_name FROM nation RIGHT OUTER JOIN region ON n_regionkey = r_regionkey AND n_nationkey < 5")
_sql("join_cross", "SELECT a.r_name AS a, b.n_name AS b FROM region a CROSS JOIN nation b")
_sql("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_sql("join_self", "SELECT a.s_name AS a, b.s_name AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey")
_sql("join_multiway", "SELECT o.o_orderkey AS o, c.c_name AS c, n.n_name AS n, r.r_name AS r FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
_sql("join_residual_where", "SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity < 3.0 AND o_orderstatus = 'F'")
_sql("join_null_keys", "SELECT a.o_orderkey AS o, c_name FROM nulled a LEFT JOIN customer ON a.k = c_custkey")
_sql("join_mixed_widths", "SELECT o_orderkey, n_name FROM orders JOIN nation ON o_orderkey = n_nationkey")

# Without an equality: nested loops over the smaller side
_sql("join_inner_theta", "SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > 9000.0")
_sql("join_left_theta", "SELECT s_suppkey, r_regionkey FROM supplier LEFT JOIN region ON s_nationkey < r_regionkey")
_sql("join_right_theta", "SELECT r_name, n_name FROM region RIGHT JOIN nation ON n_nationkey < r_regionkey AND r_name > n_name")
_sql("join_left_constant", "SELECT n_name, r_name FROM nation LEFT JOIN region ON 1 = 0")
_sql("join_null_theta", "SELECT a.o_orderkey AS o, n_nationkey FROM nulled a LEFT JOIN nation ON a.k < n_nationkey")

# Aggregates
_sql("agg_count_star", "SELECT COUNT(*) AS n FROM lineitem")
_sql("agg_count_col", "SELECT o_orderstatus, COUNT(k) AS nk, COUNT(price) AS np FROM nulled GROUP BY o_orderstatus")
_sql("agg_sum_int", "SELECT l_returnflag, SUM(l_linenumber) AS s, SUM(l_partkey) AS p FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(SUM(l_linenumber) AS BIGINT) AS s, CAST(SUM(l_partkey) AS BIGINT) AS p FROM lineitem GROUP BY l_returnflag")
_sql("agg_sum_double", "SELECT l_returnflag, SUM(l_extendedprice) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(SUM(l_extendedprice), 2) AS s FROM lineitem GROUP BY l_returnflag", {"s": 2})
_sql("agg_avg_int", "SELECT l_returnflag, AVG(l_partkey) AS a, AVG(l_linenumber) AS b FROM lineitem GROUP BY l_returnflag")
_sql("agg_avg_double", "SELECT l_linestatus, AVG(l_extendedprice) AS a FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, round(AVG(l_extendedprice), 6) AS a FROM lineitem GROUP BY l_linestatus", {"a": 6})
_sql("agg_min_max", "SELECT MIN(l_shipdate) AS d0, MAX(l_shipdate) AS d1, MIN(l_extendedprice) AS p0, MAX(l_partkey) AS k1 FROM lineitem")
_sql("agg_min_max_string", "SELECT c_mktsegment, MIN(c_name) AS lo, MAX(c_name) AS hi FROM customer GROUP BY c_mktsegment")
_sql("agg_default_names", "SELECT COUNT(*), COUNT(k), SUM(o_orderkey), MIN(o_orderstatus), AVG(k) FROM nulled", 'SELECT COUNT(*) AS "count(*)", COUNT(k) AS "count(k)", CAST(SUM(o_orderkey) AS BIGINT) AS "sum(o_orderkey)", MIN(o_orderstatus) AS "min(o_orderstatus)", AVG(k) AS "avg(k)" FROM nulled')
_sql("comments_and_escapes", "-- a comment\nSELECT c_custkey, 'it''s -- no; comment' AS q FROM customer WHERE c_mktsegment <> 'a''b' /* another; one */ AND c_custkey <= 20;", "SELECT c_custkey, 'it''s -- no; comment' AS q FROM customer WHERE c_custkey <= 20")
_sql("agg_global_empty", "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, AVG(o_custkey) AS a, MIN(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, AVG(o_custkey) AS a, MIN(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0")
_sql("group_multi", "SELECT l_linestatus, COUNT(*) AS n, l_returnflag AS flag, MAX(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus", "SELECT l_linestatus, COUNT(*) AS n, l_returnflag AS flag, MAX(l_quantity) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("group_null_key", "SELECT k, COUNT(*) AS n FROM nulled GROUP BY k")
_sql("group_no_agg", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority")
_sql("flagship", _FLAGSHIP, "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, round(AVG(l_quantity), 8) AS aq FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag, l_linestatus", {"aq": 8})

# Order and limits; every order is total before a limit
_sql("sort_multi", "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC, c_custkey", "SELECT c_mktsegment, c_custkey FROM customer ORDER BY c_mktsegment DESC NULLS LAST, c_custkey NULLS FIRST")
_sql("sort_nulls", "SELECT k, o_orderkey FROM nulled ORDER BY k, o_orderkey", f"SELECT k, o_orderkey FROM {_NULLED} ORDER BY k NULLS FIRST, o_orderkey NULLS FIRST")
_sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST LIMIT 10")
_sql("limit_offset", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 7 OFFSET 20")
_sql("limit_zero", "SELECT p_partkey FROM part LIMIT 0")
_sql("order_by_hidden", "SELECT s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5", "SELECT s_name FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey NULLS FIRST LIMIT 5")


@_made
def index_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.key_order(Tables(spark, sf_dir)["nulled"], "k").select("k", "o_orderkey")


ORACLE_SQL["index_key_order"] = f"SELECT k, o_orderkey FROM {_NULLED} WHERE k IS NOT NULL"


# Changes and transactions
def _database(spark: SparkSession, sf_dir: str, *tables: str) -> Database:
    db = Database(scratch_path(spark), spark)
    for name in tables:
        rows = Tables(spark, sf_dir)[name]
        types = {"string": "VARCHAR", "integer": "INTEGER", "long": "BIGINT", "double": "DOUBLE"}
        columns = ", ".join(f"{f.name} {types[f.dataType.typeName()]}" for f in rows.schema.fields)
        _must(db.execute(f"CREATE TABLE {name} ({columns})"))
        _must(db.load(name, rows))
    return db


def _must(result):
    if not result.ok:
        raise RuntimeError(f"{result.code}: {result.message}")
    return result


@_made
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, "nation")
    _must(db.execute("INSERT INTO nation (n_nationkey, n_name) VALUES (100, 'NOWHERE'), (-5, 'it''s')"))
    return db.dataframe("SELECT * FROM nation")


ORACLE_SQL["dml_insert"] = "SELECT * FROM nation UNION ALL SELECT 100, 'NOWHERE', NULL UNION ALL SELECT -5, 'it''s', NULL"


@_made
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, "customer")
    _must(db.execute("UPDATE customer SET c_acctbal = c_acctbal * 2, c_nationkey = c_nationkey + 1000 WHERE c_mktsegment = 'BUILDING'"))
    return db.dataframe("SELECT * FROM customer")


ORACLE_SQL["dml_update"] = "SELECT c_custkey, c_name, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey + 1000 ELSE c_nationkey END AS INTEGER) AS c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"


@_made
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, "supplier")
    _must(db.execute("DELETE FROM supplier WHERE s_acctbal < 0.0 OR s_nationkey = 3"))
    return db.dataframe("SELECT * FROM supplier")


ORACLE_SQL["dml_delete"] = "SELECT * FROM supplier WHERE NOT (s_acctbal < 0 OR s_nationkey = 3)"


@_made
def txn_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, "region")
    _must(db.begin_transaction())
    _must(db.execute("DELETE FROM region WHERE r_regionkey > 1"))
    _must(db.execute("INSERT INTO region VALUES (9, 'gone')"))
    _must(db.rollback())
    return db.dataframe("SELECT * FROM region")


ORACLE_SQL["txn_rollback"] = "SELECT * FROM region"


@_made
def txn_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a transaction sees while another thread commits, and afterwards."""
    db = _database(spark, sf_dir, "region")
    _must(db.begin_transaction())
    before = _must(db.execute("SELECT COUNT(*) FROM region")).scalar()
    other = threading.Thread(target=lambda: _must(db.execute("DELETE FROM region WHERE r_regionkey = 0")))
    other.start()
    other.join()
    during = _must(db.execute("SELECT COUNT(*) FROM region")).scalar()
    _must(db.commit())
    after = _must(db.execute("SELECT COUNT(*) FROM region")).scalar()
    return spark.createDataFrame([(before, during, after)], "before_n long, during_n long, after_n long")


ORACLE_SQL["txn_snapshot"] = "SELECT COUNT(*) AS before_n, COUNT(*) AS during_n, COUNT(*) FILTER (r_regionkey <> 0) AS after_n FROM region"


@_made
def txn_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping updates of one row: the second is aborted, the first one's value stays."""
    db = _database(spark, sf_dir, "region")
    _must(db.begin_transaction())
    other = threading.Thread(target=lambda: _must(db.execute("UPDATE region SET r_name = 'first' WHERE r_regionkey = 0")))
    other.start()
    other.join()
    outcome = db.execute("UPDATE region SET r_name = 'second' WHERE r_regionkey = 0").code.value
    db.rollback()
    return db.dataframe("SELECT r_regionkey, r_name FROM region").withColumn("outcome", F.lit(outcome))


ORACLE_SQL["txn_conflict"] = "SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'first' ELSE r_name END AS r_name, 'aborted' AS outcome FROM region"


@_made
def unique_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, "nation")
    codes = [db.execute(s).code.value for s in ("CREATE UNIQUE INDEX one ON nation (n_nationkey)", "CREATE UNIQUE INDEX two ON nation (n_regionkey)", "INSERT INTO nation VALUES (3, 'again', 0)")]
    return spark.createDataFrame([(k, c) for k, c in enumerate(codes)], "step int, outcome string")


ORACLE_SQL["unique_violation"] = "SELECT CAST(0 AS INTEGER) AS step, 'ok' AS outcome UNION ALL SELECT 1, CASE WHEN EXISTS (SELECT 1 FROM nation GROUP BY n_regionkey HAVING COUNT(*) > 1) THEN 'already exists' ELSE 'ok' END UNION ALL SELECT 2, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3) THEN 'already exists' ELSE 'ok' END"


@_made
def sum_wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer sums wrap at 64 bits; their addends reach them unharmed."""
    big = Tables(spark, sf_dir)["orders"].select("o_orderstatus", (F.lit(2**62) + F.col("o_orderkey")).alias("v"))
    return select("SELECT o_orderstatus, SUM(v) AS s FROM big GROUP BY o_orderstatus", {"big": big})


_WIDE = "SUM(CAST(4611686018427387904 + o_orderkey AS HUGEINT))"
ORACLE_SQL["sum_wraps"] = f"SELECT o_orderstatus, CAST(CASE WHEN m >= 9223372036854775808 THEN m - 18446744073709551616 ELSE m END AS BIGINT) AS s FROM (SELECT o_orderstatus, (({_WIDE} % 18446744073709551616) + 18446744073709551616) % 18446744073709551616 AS m FROM orders GROUP BY o_orderstatus)"


@_made
def narrow_store_wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers too wide for their column keep their low bits."""
    db = Database(scratch_path(spark), spark)
    _must(db.execute("CREATE TABLE narrow (id BIGINT, t TINYINT, s SMALLINT, i INTEGER)"))
    _must(db.load("narrow", Tables(spark, sf_dir)["orders"].select("o_orderkey", F.lit(0), F.lit(0), F.lit(0))))
    _must(db.execute("UPDATE narrow SET t = id * 3, s = id * 70001, i = id * 3000000001"))
    return db.dataframe("SELECT * FROM narrow")


def _low_bits(value: str, bits: int, sql_type: str) -> str:
    return f"CAST(((CAST({value} AS HUGEINT) + {2 ** (bits - 1)}) % {2**bits}) - {2 ** (bits - 1)} AS {sql_type})"


ORACLE_SQL["narrow_store_wraps"] = f"SELECT o_orderkey AS id, {_low_bits('o_orderkey * 3', 8, 'TINYINT')} AS t, {_low_bits('o_orderkey * 70001', 16, 'SMALLINT')} AS s, {_low_bits('o_orderkey * 3000000001', 32, 'INTEGER')} AS i FROM orders"


def _codes(db: Database, *statements: str) -> list[str]:
    return [db.execute(s).code.value for s in statements]


def _steps(spark: SparkSession, codes: list[str]) -> DataFrame:
    return spark.createDataFrame([(k, c) for k, c in enumerate(codes)], "step int, outcome string")


def _steps_sql(*codes: str) -> str:
    """Outcomes that tables cannot tell: where it can, a code is an expression."""
    parts = [c if c.startswith("CASE") else f"'{c}'" for c in codes]
    return " UNION ALL ".join(f"SELECT CAST({k} AS INTEGER) AS step, {c} AS outcome" for k, c in enumerate(parts))


@_made
def drop_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dropped table's name is free again, for other columns and rows; its indexes are gone."""
    db = _database(spark, sf_dir, "nation", "region")
    for s in ("CREATE INDEX i ON region (r_regionkey)", "DROP TABLE region", "CREATE TABLE region (r_name VARCHAR(20))", "CREATE INDEX i ON region (r_name)"):
        _must(db.execute(s))
    _must(db.load("region", Tables(spark, sf_dir)["region"].where("r_regionkey > 1").select("r_name")))
    return db.dataframe("SELECT * FROM region")


ORACLE_SQL["drop_table"] = "SELECT r_name FROM region WHERE r_regionkey > 1"


@_made
def definition_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, "region")
    return _steps(spark, _codes(db, "DROP TABLE nothing", "CREATE INDEX i ON region (r_name)", "CREATE INDEX i ON region (r_regionkey)", "DROP INDEX i ON region", "DROP INDEX i", "CREATE TABLE region (a INTEGER)", "DROP TABLE region", "SELECT * FROM region"))


ORACLE_SQL["definition_outcomes"] = _steps_sql("not found", "ok", "already exists", "ok", "not found", "already exists", "ok", "not found")


@_made
def index_follows_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups through an indexed column after inserts, updates and deletes."""
    db = _database(spark, sf_dir, "customer")
    for s in ("CREATE INDEX i ON customer (c_nationkey)", "UPDATE customer SET c_nationkey = 77 WHERE c_custkey < 50", "DELETE FROM customer WHERE c_custkey < 10", "INSERT INTO customer (c_custkey, c_nationkey) VALUES (-1, 77)"):
        _must(db.execute(s))
    return db.dataframe("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 77")


ORACLE_SQL["index_follows_changes"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey BETWEEN 10 AND 49 UNION ALL SELECT -1, NULL"


@_made
def strict_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literals in and out of their column's range, without and with strict mode; what was stored follows from the last step."""
    codes = []
    for strict in (False, True):
        with Database(scratch_path(spark), spark, strict_mode=strict) as db:
            codes += _codes(db, "CREATE TABLE t (i INTEGER, v VARCHAR(9))", "INSERT INTO t VALUES (3000000000, 'a')", "INSERT INTO t VALUES ('x', 'a')", "INSERT INTO t VALUES (1, 2)", "INSERT INTO t VALUES (1, 'ok')")
    return _steps(spark, codes)


ORACLE_SQL["strict_outcomes"] = _steps_sql("ok", "ok", *["invalid argument"] * 2, "ok", "ok", *["invalid argument"] * 3, "ok")


@_made
def txn_poisoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement that fails inside a transaction fails all later ones, and its commit; nothing of it stays."""
    db = _database(spark, sf_dir, "region")
    codes = [db.begin_transaction().code.value, *_codes(db, "DELETE FROM region", "SELECT nothing FROM region", "SELECT * FROM region"), db.commit().code.value]
    left = _must(db.execute("SELECT COUNT(*) FROM region")).scalar()
    return _steps(spark, [*codes, str(left)])


ORACLE_SQL["txn_poisoned"] = _steps_sql("ok", "ok", "invalid argument", "aborted", "aborted") + " UNION ALL SELECT 5, CAST(COUNT(*) AS VARCHAR) FROM region"


@_made
def txn_deadlock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two transactions that wait for each other's row: the younger one is aborted, the older one's changes stay."""
    db = _database(spark, sf_dir, "region")
    _must(db.begin_transaction())
    _must(db.execute("UPDATE region SET r_name = 'older' WHERE r_regionkey = 0"))
    held, codes = threading.Event(), []

    def younger() -> None:
        _must(db.begin_transaction())
        _must(db.execute("UPDATE region SET r_name = 'younger' WHERE r_regionkey = 1"))
        held.set()
        codes.append(db.execute("UPDATE region SET r_name = 'younger' WHERE r_regionkey = 0").code.value)
        db.rollback()

    other = threading.Thread(target=younger)
    other.start()
    held.wait(60)
    _must(db.execute("UPDATE region SET r_name = 'older' WHERE r_regionkey = 1"))
    other.join()
    _must(db.commit())
    return db.dataframe("SELECT r_regionkey, r_name FROM region").withColumn("outcome", F.lit(codes[0]))


ORACLE_SQL["txn_deadlock"] = "SELECT r_regionkey, CASE WHEN r_regionkey < 2 THEN 'older' ELSE r_name END AS r_name, 'aborted' AS outcome FROM region"


@_made
def txn_many_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two open transactions change different halves of a table, however many rows; both commit."""
    db = _database(spark, sf_dir, "lineitem_keys")
    _must(db.begin_transaction())
    _must(db.execute("UPDATE lineitem_keys SET v = 1 WHERE k <= 5000"))
    other = threading.Thread(target=lambda: _must(db.execute("UPDATE lineitem_keys SET v = 2 WHERE k > 5000")))
    other.start()
    other.join()
    _must(db.commit())
    return db.dataframe("SELECT v, COUNT(*) AS n FROM lineitem_keys GROUP BY v")


ORACLE_SQL["txn_many_rows"] = "SELECT CAST(CASE WHEN l_orderkey <= 5000 THEN 1 ELSE 2 END AS INTEGER) AS v, COUNT(*) AS n FROM lineitem GROUP BY 1"


@_made
def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another Database object finds at the path after commits, a rollback, a compaction and a close."""
    path = scratch_path(spark)
    with Database(path, spark) as db:
        _must(db.execute("CREATE TABLE nation (n_nationkey INTEGER, n_name VARCHAR(25), n_regionkey INTEGER)"))
        _must(db.load("nation", Tables(spark, sf_dir)["nation"]))
        _must(db.execute("DELETE FROM nation WHERE n_regionkey = 2"))
        _must(db.begin_transaction())
        _must(db.execute("DELETE FROM nation"))
        _must(db.rollback())
        _must(db.compact("nation"))
        _must(db.execute("UPDATE nation SET n_regionkey = 7 WHERE n_regionkey = 3"))
    return Database(path, spark, create_if_missing=False).dataframe("SELECT * FROM nation")


ORACLE_SQL["reopened"] = "SELECT n_nationkey, n_name, CAST(CASE WHEN n_regionkey = 3 THEN 7 ELSE n_regionkey END AS INTEGER) AS n_regionkey FROM nation WHERE n_regionkey <> 2"


@_made
def explain_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _database(spark, sf_dir, "nation", "supplier")
    found = _must(db.execute("EXPLAIN SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey ORDER BY n_name LIMIT 3"))
    text = "\n".join(line for (line,) in found.rows)
    needles = ["Sequential Scan", "Hash Join", "cost=", "Sort", "Limit", "Estimated Rows"]
    return spark.createDataFrame([(n, n in text) for n in needles], "needle string, present boolean")


ORACLE_SQL["explain_shape"] = "SELECT unnest(['Sequential Scan', 'Hash Join', 'cost=', 'Sort', 'Limit', 'Estimated Rows']) AS needle, true AS present"


# Statistics and run-log figures, with events standing in for runs
@_made
def stats_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.profile(Tables(spark, sf_dir)["nulled"], ["o_orderkey", "k", "o_orderstatus"])


ORACLE_SQL["stats_profile"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(DISTINCT {c}) AS n_distinct, COUNT(*) FILTER ({c} IS NULL) / COUNT(*) AS null_fraction, CAST(MIN({c}) AS VARCHAR) AS least, CAST(MAX({c}) AS VARCHAR) AS greatest FROM {_NULLED}"
    for c in ("o_orderkey", "k", "o_orderstatus")
)

_OUTCOME = "CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'click' THEN 'fail' ELSE 'pass' END"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "error").when(kind == "click", "fail").otherwise("pass")
    return Tables(spark, sf_dir)["events"].select("event_id", "value", kind.alias("schedule"), outcome.alias("outcome"), (F.col("user_id") % 4).cast("int").alias("faults_injected"))


_RUNS = f"(SELECT event_id, value, event_type AS schedule, {_OUTCOME} AS outcome, CAST(user_id % 4 AS INTEGER) AS faults_injected FROM events)"


@_made
def runlog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written as JSON lines to two folders, read back and merged in their order."""
    base = scratch_path(spark)
    runs = Tables(spark, sf_dir)["events"].select(
        F.col("event_id").alias("seed"), F.col("event_type").alias("schedule"), (F.col("user_id") % 4).cast("int").alias("faults_injected"), F.lit("").alias("crash_point"),
        F.when(F.col("event_type") == "error", "error").otherwise("pass").alias("outcome"), F.array(F.col("event_type")).alias("invariants_failed"),
        *(F.lit(0).cast("long").alias(c) for c in ("ops", "redo_ops", "undo_ops")), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("recovery_ms"),
    )
    paths = [f"{base}-even", f"{base}-odd"]
    for k, path in enumerate(paths):
        run_logs.write(runs.where(F.col("seed") % 2 == k), path)
    return run_logs.merge(spark, paths).select("source_no", "seed", "schedule", "faults_injected", "outcome", F.col("invariants_failed")[0].alias("failed"), F.round("recovery_ms", 6).alias("recovery_ms"))


ORACLE_SQL["runlog_files"] = "SELECT CAST(event_id % 2 AS INTEGER) AS source_no, event_id AS seed, event_type AS schedule, CAST(user_id % 4 AS INTEGER) AS faults_injected, CASE WHEN event_type = 'error' THEN 'error' ELSE 'pass' END AS outcome, event_type AS failed, CASE WHEN event_id % 3 <> 0 THEN round(value, 6) END AS recovery_ms FROM events"


@_made
def runlog_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_logs.outcome_counts(_runs(spark, sf_dir))


ORACLE_SQL["runlog_outcomes"] = f"SELECT COUNT(*) AS total, COUNT(*) FILTER (outcome = 'pass') AS passed, COUNT(*) FILTER (outcome = 'fail') AS failed, COUNT(*) FILTER (outcome = 'error') AS errored, CAST(SUM(faults_injected) AS BIGINT) AS total_faults, COUNT(*) FILTER (outcome = 'pass') / COUNT(*) AS pass_rate FROM {_RUNS}"


@_made
def runlog_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_logs.percentiles(_runs(spark, sf_dir), "value").withColumns({c: F.round(c, 8) for c in ("p50", "p99", "most")})


ORACLE_SQL["runlog_percentile"] = f"SELECT round(quantile_cont(value, 0.5), 8) AS p50, round(quantile_cont(value, 0.99), 8) AS p99, round(MAX(value), 8) AS most FROM {_RUNS}"


@_made
def runlog_by_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_logs.by_schedule(_runs(spark, sf_dir))


ORACLE_SQL["runlog_by_schedule"] = f"SELECT schedule, COUNT(*) FILTER (outcome = 'pass') AS passed, COUNT(*) FILTER (outcome <> 'pass') AS failed FROM {_RUNS} GROUP BY schedule"


@_made
def runlog_fault_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_logs.fault_totals(_runs(spark, sf_dir), "schedule", "faults_injected")


ORACLE_SQL["runlog_fault_totals"] = f"SELECT schedule AS kind, CAST(SUM(faults_injected) AS BIGINT) AS total FROM {_RUNS} GROUP BY schedule"


@_made
def runlog_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_logs.first_seen(_runs(spark, sf_dir), "schedule", "event_id")


ORACLE_SQL["runlog_first_seen"] = f"SELECT schedule AS value, CAST(row_number() OVER (ORDER BY MIN(event_id)) AS INTEGER) AS first_place FROM {_RUNS} GROUP BY schedule"
