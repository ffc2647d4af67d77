"""Ranks and running numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import materialize

GROUP_BOUND = 1_000_000
_SLICES = 256


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per key.

    Spark itself applies limits up to a threshold before the shuffle. A larger ``k`` is
    applied to salted slices of each key first, so that no task sorts a whole key.
    """
    threshold = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if k > threshold:
        plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        salt = F.pmod(F.xxhash64(*plain), F.lit(_SLICES))
        sliced = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = df.withColumn("_slice", salt).withColumn("_rank", F.row_number().over(sliced))
        df = df.where(F.col("_rank") <= k).drop("_slice", "_rank")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def running_number(
    df: DataFrame, keys: list[str], order: list[Column], out: str, group_bound: int = GROUP_BOUND
) -> DataFrame:
    """Number the rows 1, 2, … within each key; ``order`` must be total, keys not null.

    ``df`` should be materialized: its largest group is measured first. Groups within
    ``group_bound`` rows take a plain window. With larger ones the rows are range
    partitioned by key and order, numbered per partition, and shifted by the sizes of
    the partitions before, so that no task holds a whole group.
    """
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= group_bound:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    spread = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    spread = materialize(spread.withColumn("_slice", F.spark_partition_id()), "ordered")
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        spread.groupBy(*keys, "_slice")
        .count()
        .withColumn("_shift", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = spread.withColumn("_local", F.row_number().over(local)).join(shifts, [*keys, "_slice"])
    return numbered.withColumn(out, (F.col("_local") + F.col("_shift")).cast("int")).drop("_slice", "_local", "_shift")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the last ``value`` that is not null among the earlier rows of the key.

    Rows are range partitioned by key and order; a partition starts with the last value of those before it,
    which is one row per key and partition. So no task holds a whole key. Equal rows in ``order`` do not see
    each other in a defined way; make it total where that matters.
    """
    spread = df.repartitionByRange(*keys, *order)
    spread = materialize(spread.withColumn("_slice", F.spark_partition_id()), "ordered")
    latest = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    slices = spread.groupBy(*keys, "_slice").agg(latest.alias("_latest"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_carried", F.last("_latest", ignorenulls=True).over(before)).drop("_latest")
    local = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carried = spread.withColumn("_own", F.last(value, ignorenulls=True).over(local)).join(slices, [*keys, "_slice"])
    return carried.withColumn(out, F.coalesce("_own", "_carried")).drop("_slice", "_own", "_carried")
