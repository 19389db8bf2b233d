"""SQL types, their Spark types, and the families that decide which operands go together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from orrery.status import StatusCode, SqlError

INTEGERS = {"TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INTEGER": T.IntegerType(), "BIGINT": T.LongType()}
FLOATS = {"FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "DECIMAL": T.DoubleType()}  # DECIMAL values are doubles here
STRINGS = {"VARCHAR": T.StringType(), "CHAR": T.StringType(), "TEXT": T.StringType()}
#: Integers that the client gives a meaning; they compare with anything and take no arithmetic.
TIMES = {"TIMESTAMP": T.LongType(), "DATE": T.LongType()}
SPARK_TYPES = INTEGERS | FLOATS | STRINGS | TIMES | {"BOOLEAN": T.BooleanType()}
SPELLINGS = {name: name for name in SPARK_TYPES} | {"INT": "INTEGER"}


def family(sql_type: str) -> str:
    if sql_type in INTEGERS or sql_type in FLOATS:
        return "numeric"
    if sql_type in STRINGS:
        return "string"
    return "boolean" if sql_type == "BOOLEAN" else "unknown"


def of_spark(t: T.DataType) -> str:
    """The SQL type of a column of a table that was not declared here; OTHER where there is none."""
    if isinstance(t, T.DecimalType):
        return "DECIMAL"
    named = {"byte": "TINYINT", "short": "SMALLINT", "integer": "INTEGER", "long": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    return named.get(t.typeName(), "OTHER")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    sql_type: str
    length: int | None = None

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.sql_type]


def stored_value(value: object, column: ColumnSpec, strict: bool) -> object:
    """A literal as the column stores it. Integers out of range wrap, unless strict; other kinds never turn into each other."""
    if value is None:
        return None
    t = column.sql_type
    kind = "BOOLEAN" if isinstance(value, bool) else "int" if isinstance(value, int) else "float" if isinstance(value, float) else "string"
    if kind == "int" and (t in INTEGERS or t in TIMES):
        bits = {"TINYINT": 8, "SMALLINT": 16, "INTEGER": 32}.get(t, 64)
        wrapped = (value + 2 ** (bits - 1)) % 2**bits - 2 ** (bits - 1)
        if strict and wrapped != value:
            raise SqlError(StatusCode.INVALID_ARGUMENT, f"{value} is out of range for column {column.name} ({t})")
        return wrapped
    if kind in ("int", "float") and t in FLOATS:
        return float(value)
    if (kind == "string" and t in STRINGS) or (kind == "BOOLEAN" and t == "BOOLEAN"):
        return value
    reason = "does not match the type of" if strict else "cannot be stored in"
    raise SqlError(StatusCode.INVALID_ARGUMENT, f"a {kind.lower()} value {reason} column {column.name} ({t})")
