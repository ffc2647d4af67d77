"""Join shapes that hold up when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_hot(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join where one key may hold a large share of ``right``.

    Adaptive execution splits a skewed right side of an inner join but not of an outer
    one. So rows with a partner come from an inner join and the others from an anti
    join against the distinct keys.
    """
    matched = left.join(right, keys)
    lonely = left.join(right.select(*keys).distinct(), keys, "left_anti")
    fillers = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields if f.name not in keys]
    return matched.unionByName(lonely.select("*", *fillers))


def by_sorting(df: DataFrame) -> DataFrame:
    """``df`` for a join in which no side is to be broadcast.

    Spark guesses a table's memory from its files. Facts take a twentieth of it there, so millions of them seemed
    small enough to go through the driver, several times in one plan.
    """
    return df.hint("merge")
