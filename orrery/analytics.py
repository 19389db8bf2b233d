"""Column statistics of a table, as a planner would collect them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_rows, n_distinct, null_fraction, least, greatest) a column, bounds as text; one aggregate, whose one row is turned into one a column."""

    def figures(c: str):
        n = F.count("*")
        return F.struct(
            F.lit(c).alias("column_name"), n.alias("n_rows"), F.count_distinct(c).alias("n_distinct"),
            F.coalesce(F.count_if(F.col(c).isNull()) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("null_fraction"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest"),
        )

    one = df.select(*columns).agg(*(figures(c).alias(f"s{k}") for k, c in enumerate(columns)))
    return one.select(F.inline(F.array(*(f"s{k}" for k in range(len(columns))))))
