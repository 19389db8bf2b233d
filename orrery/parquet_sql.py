"""The dialect's SELECT over any DataFrames, without a database: lazily planned, executed by Spark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from orrery.plans import nodes as N
from orrery.plans.parser import parse
from orrery.plans.planner import Source, not_found, plan_select
from orrery.status import invalid
from orrery.types import of_spark


def select(text: str, tables: Mapping[str, DataFrame]) -> DataFrame:
    """The result of one SELECT statement over the named tables; SqlError if it is not valid."""
    statement = parse(text)
    if not isinstance(statement, N.Select):
        raise invalid("a SELECT is needed")

    def source(name: str) -> Source:
        if name not in tables:
            raise not_found(name)
        return Source(tables[name], [(f.name, of_spark(f.dataType)) for f in tables[name].schema.fields])

    return plan_select(statement, source).named()
