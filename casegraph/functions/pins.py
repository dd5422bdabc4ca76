"""Keeping computed columns computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as the one row of a generator, which the optimizer doesn't copy into later expressions.

    Higher-order functions name their inputs many times, also within lambdas; without this, each mention could become
    the whole expression again. No shuffle, one row for each row.
    """
    held = df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_pinned"))
    return held.select(*(c for c in df.columns if c not in columns), *(F.col(f"_pinned.{n}").alias(n) for n in columns))
