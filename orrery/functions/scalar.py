"""Scalar expressions as Spark columns, with the dialect's value semantics under either ANSI setting.

Integers widen to 64 bits; overflow, division by zero and MIN / -1 give NULL, and integer division truncates. Comparisons never cross type families.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.plans import nodes as N
from orrery.status import invalid
from orrery.types import FLOATS, INTEGERS, family

MIN_BIGINT, MAX_BIGINT = -(2**63), 2**63 - 1
#: Sums and products name their operands several times. An expression that would grow beyond this size (five operators or more in one another) takes
#: Spark's try_ function for its outer one, which names each once: right, too, but slow for values that overflow there.
PLAIN_SIZE = 500


@dataclass(frozen=True)
class Typed:
    column: Column
    sql_type: str  # a SQL type, OTHER, or NULL for the bare literal
    size: int = 1  # about the number of nodes
    value: int | None = None  # of an integer literal of 64 bits

    @property
    def family(self) -> str:
        return "null" if self.sql_type == "NULL" else family(self.sql_type)


Resolve = Callable[[N.Name], Typed]


def lower(node: object, resolve: Resolve) -> Typed:
    """The column and type of an expression; names come from resolve."""
    if isinstance(node, N.Literal):
        return literal(node.value)
    if isinstance(node, N.Name):
        return resolve(node)
    if isinstance(node, N.IsNull):
        inner = lower(node.operand, resolve).column
        return Typed(inner.isNotNull() if node.negated else inner.isNull(), "BOOLEAN")
    if isinstance(node, N.Unary):
        operand = lower(node.operand, resolve)
        return logical_not(operand) if node.op == "NOT" else arithmetic("-", literal(0), operand)
    if isinstance(node, N.Binary):
        left, right = lower(node.left, resolve), lower(node.right, resolve)
        if node.op in ("AND", "OR"):
            return logical(node.op, left, right)
        return arithmetic(node.op, left, right) if node.op in "+-*/" else comparison(node.op, left, right)
    raise invalid("an aggregate cannot stand here")


def literal(value: int | float | str | bool | None) -> Typed:
    if value is None:
        return Typed(F.lit(None), "NULL")
    if isinstance(value, bool):
        return Typed(F.lit(value), "BOOLEAN")
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), "BIGINT", value=value if MIN_BIGINT <= value <= MAX_BIGINT else None)
    return Typed(F.lit(value), "DOUBLE" if isinstance(value, float) else "VARCHAR")


def predicate(node: object, resolve: Resolve) -> Column:
    """A condition: boolean, or the bare NULL, which holds nowhere."""
    found = lower(node, resolve)
    if found.family not in ("boolean", "null"):
        raise invalid(f"a condition must be boolean, not {found.sql_type}")
    return found.column.cast("boolean")


def arithmetic(op: str, left: Typed, right: Typed) -> Typed:
    for side in (left, right):
        if side.family not in ("numeric", "null"):
            raise invalid(f"{op} needs numbers, not {side.sql_type}")
    if left.sql_type in FLOATS or right.sql_type in FLOATS:
        a, b = left.column.cast("double"), right.column.cast("double")
        size = left.size + 2 * right.size + 2
        if op == "/":
            return Typed(a / F.when(b != 0.0, b), "DOUBLE", size)
        return Typed(a + b if op == "+" else a - b if op == "-" else a * b, "DOUBLE", size)
    if op == "*" and (left.value is not None or (right.value is None and right.size > left.size)):
        left, right = right, left  # the second factor is best a literal
    a, b = left.column.cast("bigint"), right.column.cast("bigint")
    if op == "/":
        return Typed(_quotient(a, b), "BIGINT", 3 * left.size + 5 * right.size + 10)
    size = {"+": 3, "-": 3, "*": 4}[op] * left.size + {"+": 3, "-": 3, "*": 15}[op] * right.size + 10
    if right.value is not None:
        size = {"+": 2, "-": 2, "*": 3}[op] * left.size + 5
    if size > PLAIN_SIZE:
        return Typed({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b), "BIGINT", left.size + right.size + 1)
    return Typed({"+": _sum, "-": _difference, "*": _product}[op](a, b, right.value), "BIGINT", size)


# Exact or NULL, under either ANSI setting. A guard on one operand keeps what would overflow from being computed: Spark's try_ functions raise and catch
# an exception for each such value, at tens of microseconds. The bounds themselves cannot overflow. least and greatest pass over NULL, the result does not.


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _sum(a: Column, b: Column, value: int | None) -> Column:
    if value is not None:
        return F.when(a <= _long(MAX_BIGINT - value) if value >= 0 else a >= _long(MIN_BIGINT - value), a) + b
    return F.when(a.between(_long(MIN_BIGINT) - F.least(b, _long(0)), _long(MAX_BIGINT) - F.greatest(b, _long(0))), a) + b


def _difference(a: Column, b: Column, value: int | None) -> Column:
    if value is not None:
        return F.when(a >= _long(MIN_BIGINT + value) if value >= 0 else a <= _long(MAX_BIGINT + value), a) - b
    return F.when(a.between(_long(MIN_BIGINT) + F.greatest(b, _long(0)), _long(MAX_BIGINT) + F.least(b, _long(0))), a) - b


def _product(a: Column, b: Column, value: int | None) -> Column:
    if value is not None:
        down, up = (-(-MIN_BIGINT // value), MAX_BIGINT // value) if value > 0 else (-(MAX_BIGINT // -value), min(MIN_BIGINT // value, MAX_BIGINT)) if value else (MIN_BIGINT, MAX_BIGINT)
        return F.when(a.between(_long(down), _long(up)), a) * b
    divisor = F.when((b > 0) | (b < -1), b)  # NULL for 0 and -1, which need no bounds
    x, y = F.call_function("div", _long(MIN_BIGINT), divisor), F.call_function("div", _long(MAX_BIGINT), divisor)
    return F.when((b == 0) | ((b == -1) & (a != _long(MIN_BIGINT))) | a.between(F.least(x, y), F.greatest(x, y)), a) * b


def _quotient(a: Column, b: Column) -> Column:
    # The guard also keeps the quotient from being evaluated where it would fail.
    safe = (b != 0) & ~((a == _long(MIN_BIGINT)) & (b == -1))
    return F.call_function("div", F.when(safe, a), F.when(safe, b))


def comparable(left: Typed, right: Typed) -> tuple[Column, Column]:
    """Both sides of a comparison in one type."""
    families = {left.family, right.family} - {"null", "unknown"}
    if len(families) > 1:
        raise invalid(f"cannot compare {left.sql_type} with {right.sql_type}")
    if left.family == right.family == "numeric":
        wide = "bigint" if left.sql_type in INTEGERS and right.sql_type in INTEGERS else "double"
        return left.column.cast(wide), right.column.cast(wide)
    return left.column, right.column


def comparison(op: str, left: Typed, right: Typed) -> Typed:
    a, b = comparable(left, right)
    if "null" in (left.family, right.family):
        return Typed(F.lit(None).cast("boolean"), "BOOLEAN")
    found = {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
    return Typed(found[op], "BOOLEAN")


def _boolean(side: Typed, op: str) -> Column:
    if side.family not in ("boolean", "null"):
        raise invalid(f"{op} needs booleans, not {side.sql_type}")
    return side.column.cast("boolean")


def logical(op: str, left: Typed, right: Typed) -> Typed:
    a, b = _boolean(left, op), _boolean(right, op)
    return Typed(a & b if op == "AND" else a | b, "BOOLEAN")


def logical_not(operand: Typed) -> Typed:
    return Typed(~_boolean(operand, "NOT"), "BOOLEAN")
