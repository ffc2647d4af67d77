"""Splitting groups of any size into tiles that pairs of tasks can work on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tile_counts(df: DataFrame, group: list[str], rows: int, out: str) -> DataFrame:
    return df.groupBy(*group).agg(F.ceil(F.count("*") / rows).cast("int").alias(out))


def _numbers(count: str) -> F.Column:
    return F.explode(F.sequence(F.lit(0), F.col(count) - 1))


def tile_of(ident: str, count: str) -> F.Column:
    return F.pmod(F.xxhash64(ident), count).cast("int")


def cross_tiles(
    left: DataFrame, right: DataFrame, group: list[str], left_id: str, right_id: str, rows: int
) -> tuple[DataFrame, DataFrame]:
    """Place rows of two tables into all pairs (l_tile, r_tile) of tiles of a common group."""
    sizes = tile_counts(left, group, rows, "_l_tiles").join(tile_counts(right, group, rows, "_r_tiles"), group)
    placed_left = left.join(sizes, group).withColumn("l_tile", tile_of(left_id, "_l_tiles"))
    placed_left = placed_left.withColumn("r_tile", _numbers("_r_tiles")).drop("_l_tiles", "_r_tiles")
    placed_right = right.join(sizes, group).withColumn("r_tile", tile_of(right_id, "_r_tiles"))
    placed_right = placed_right.withColumn("l_tile", _numbers("_l_tiles")).drop("_l_tiles", "_r_tiles")
    return placed_left, placed_right
