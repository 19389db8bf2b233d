"""The five aggregates, exact over integers under either ANSI setting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.functions.scalar import Typed
from orrery.status import invalid
from orrery.types import FLOATS, INTEGERS

_NARROW = ("TINYINT", "SMALLINT", "INTEGER")


def count(argument: Typed | None) -> Typed:
    return Typed(F.count("*") if argument is None else F.count(argument.column), "BIGINT")


def _wide_sum(argument: Typed) -> Column:
    """Exact sum as a decimal. Narrow integers are added as 64-bit ones, which 2^32 rows of them cannot overflow. Wide ones are added in three
    limbs of 21, 21 and 22 bits, which 2^41 rows cannot overflow, so that the hot loop adds plain longs and decimals appear once a group."""
    v = argument.column.cast("bigint")
    if argument.sql_type in _NARROW:
        return F.sum(v).cast("decimal(38,0)")
    mask = F.lit(2**21 - 1).cast("bigint")
    limbs = [(v.bitwiseAND(mask), 1), (F.shiftright(v, 21).bitwiseAND(mask), 2**21), (F.shiftright(v, 42), 2**42)]
    low, middle, high = (F.sum(limb).cast("decimal(20,0)") * F.lit(str(unit)).cast("decimal(14,0)") for limb, unit in limbs)
    return (low + middle + high).cast("decimal(38,0)")


def sum_(argument: Typed, ansi: bool) -> Typed:
    """Integers add up modulo 2^64 to a BIGINT. Without ANSI, Spark's own sum wraps just so; with it, that would fail, and the exact sum is folded."""
    _numeric("SUM", argument)
    if argument.sql_type in FLOATS:
        return Typed(F.sum(argument.column.cast("double")), "DOUBLE")
    if not ansi or argument.sql_type in _NARROW:
        return Typed(F.sum(argument.column.cast("bigint")), "BIGINT")
    half, whole = F.lit("9223372036854775808").cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)")
    return Typed((F.pmod(_wide_sum(argument) + half, whole) - half).cast("bigint"), "BIGINT")


def avg(argument: Typed) -> Typed:
    """Integers: the exact sum over the count, with 18 decimals before it becomes a double; sums beyond 10^20 divide as doubles."""
    _numeric("AVG", argument)
    if argument.sql_type in FLOATS:
        return Typed(F.avg(argument.column.cast("double")), "DOUBLE")
    total, n = _wide_sum(argument), F.count(argument.column)
    fits = F.abs(total) < F.lit("100000000000000000000").cast("decimal(38,0)")
    exact = F.when(fits, total).cast("decimal(20,0)") / F.when(n > 0, n).cast("decimal(20,0)")
    return Typed(F.coalesce(exact.cast("double"), total.cast("double") / F.when(n > 0, n)), "DOUBLE")


def least(argument: Typed) -> Typed:
    return Typed(F.min(argument.column), argument.sql_type)


def greatest(argument: Typed) -> Typed:
    return Typed(F.max(argument.column), argument.sql_type)


def lower_aggregate(function: str, argument: Typed | None, ansi: bool) -> Typed:
    if function == "COUNT":
        return count(argument)
    if function == "SUM":
        return sum_(argument, ansi)
    return {"AVG": avg, "MIN": least, "MAX": greatest}[function](argument)


def _numeric(name: str, argument: Typed) -> None:
    if argument.sql_type not in INTEGERS and argument.sql_type not in FLOATS:
        raise invalid(f"{name} needs a number, not {argument.sql_type}")
