"""Tiles of vectors around pivots: pairs of tiles that lie too far apart are never compared.

On the unit sphere the angle is a metric. With every vector in the cell of its nearest pivot and the largest angle of a
cell known, two vectors of cells A and B are at least angle(pivot A, pivot B) - radius A - radius B apart. Where that
is more than the angle of the least cosine wanted, no pair of the two cells can reach it, and the pair of cells
is left out without a look at its vectors. The bound is exact: nothing is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.vectors import dot
from factloom.operators.nearest import matrix, unit_rows
from factloom.operators.ranking import top_k
from factloom.operators.tiling import tile_of
from factloom.session import materialize

MOST_PIVOTS = 256
#: Tiles smaller than this are compared together, in one task for two bundles of them.
BUNDLE_ROWS = 4096
#: Rounding of angles, far above that of the cosines they come from.
SLACK = 1e-6
_CHUNK = 1 << 16


def _pivots(items: DataFrame, group: list[str], ident: str, rows: int) -> DataFrame:
    """Pivots of each group that does not fit one tile: group + [pivot, unit], at most one per tile."""
    counts = items.groupBy(*group).agg(F.count("*").alias("_n")).where(F.col("_n") > rows)
    wanted = F.least(F.lit(MOST_PIVOTS), F.ceil(F.col("_n") / rows) * 2).cast("int")
    counts = materialize(counts.select(*group, wanted.alias("_pivots")), "pivot-counts")
    drawn = items.join(counts, group).select(*group, ident, "embedding", "_pivots", F.xxhash64(ident).alias("_order"))
    drawn = top_k(drawn, group, [F.asc("_order"), F.asc(ident)], MOST_PIVOTS, rank="pivot").where("pivot <= _pivots")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform("embedding", lambda x: x.cast("double") / length)
    return materialize(drawn.select(*group, "pivot", unit.alias("unit")), "pivots")


def _assign(batches: Iterable[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, chunk and kind: the pivots of a group come first, then its vectors pass by."""
    now, units, numbers = None, [], []
    for batch in batches:
        runs = list(zip(batch.column("_key").to_pylist(), batch.column("_chunk").to_pylist(), batch.column("_pivot").is_valid().to_pylist(), strict=True))
        cuts = [i for i in range(1, len(runs)) if runs[i] != runs[i - 1]]
        for start, end in zip([0, *cuts], [*cuts, len(runs)], strict=True):
            if end <= start:
                continue
            part, (key, chunk, is_pivot) = batch.slice(start, end - start), runs[start]
            if (key, chunk) != now:
                now, units, numbers = (key, chunk), [], []
            vectors = unit_rows(matrix(part.column("embedding")))
            if is_pivot:
                units.append(vectors)
                numbers.append(part.column("_pivot").to_numpy())
                continue
            cosines = vectors @ np.concatenate(units).T
            nearest = cosines.argmax(1)
            angles = np.arccos(np.clip(cosines[np.arange(len(nearest)), nearest], -1.0, 1.0))
            cells = np.concatenate(numbers)[nearest].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.select(keep).columns, pa.array(cells), pa.array(angles)], names=[*keep, "pivot", "angle"])


def pivot_cells(items: DataFrame, group: list[str], ident: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """(items of groups larger than a tile, with pivot and angle; the pivots). Vectors must have a length."""
    pivots = _pivots(items, group, ident, rows)
    # Grouping columns as one key that is never null and compares cheaply in the scan.
    key = F.to_json(F.struct(*group)).alias("_key")
    large = items.join(pivots.select(*group).distinct(), group, "left_semi")
    chunks = F.ceil(F.count("*") / _CHUNK).cast("int")
    sizes = materialize(large.groupBy(*group).agg(chunks.alias("_chunks")), "chunks")
    rest = [c for c in items.columns if c not in ("embedding", *group)]
    left = large.join(sizes, group).withColumn("_chunk", tile_of(ident, "_chunks"))
    left = left.select(key, "_chunk", F.lit(None).cast("int").alias("_pivot"), "embedding", *group, F.struct(*rest).alias("_rest"))
    right = pivots.join(sizes, group).withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    kind = items.schema["embedding"].dataType
    right = right.select(key, "_chunk", F.col("pivot").alias("_pivot"), F.col("unit").cast("array<double>").alias("embedding"), *group)
    both = left.withColumn("embedding", F.col("embedding").cast("array<double>")).unionByName(right, allowMissingColumns=True)
    dealt = both.repartition("_key", "_chunk").sortWithinPartitions("_key", "_chunk", F.col("_pivot").isNull())
    keep = [*group, "embedding", "_rest"]
    schema = T.StructType([*[both.schema[c] for c in keep], T.StructField("pivot", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    placed = dealt.mapInArrow(lambda batches: _assign(batches, keep), schema)
    placed = placed.select(*group, F.col("embedding").cast(kind).alias("embedding"), "_rest.*", "pivot", "angle")
    return materialize(placed, "cells"), pivots


def _arc(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def tile_pairs(cells: DataFrame, pivots: DataFrame, group: list[str], rows: int, least_cosine: float) -> DataFrame:
    """Pairs of tiles that may hold a pair of cosine >= ``least_cosine``: group + [low, high], each a struct (pivot, node, part).

    A cell is cut into parts of about ``rows`` vectors. A node (group of equal titles) of more than ``rows`` vectors
    has cells of its own, whose parts are not paired with each other."""
    cell = [*group, "pivot", "heavy"]
    sizes = cells.groupBy(*cell).agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    parts = F.sequence(F.lit(0), F.ceil(F.col("n") / rows).cast("int") - 1)
    tiles = sizes.select(*cell, "radius", F.explode(parts).alias("part"))
    tiles = materialize(tiles.withColumn("tile", F.struct("pivot", "heavy", "part")), "tiles", plain=True)

    a, b = pivots.alias("a"), pivots.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in group]
    near = a.join(b, [*same, F.col("a.pivot") <= F.col("b.pivot")])
    apart = F.when(F.col("a.pivot") == F.col("b.pivot"), 0.0).otherwise(_arc(dot("a.unit", "b.unit")))
    widest = tiles.groupBy(*group, "pivot").agg(F.max("radius").alias("radius"))
    angles = near.select(*[F.col(f"a.{c}").alias(c) for c in group], F.col("a.pivot").alias("p"), F.col("b.pivot").alias("q"), apart.alias("apart"))
    reach = F.lit(math.acos(max(-1.0, min(1.0, least_cosine))) + SLACK)
    for end in ("p", "q"):
        angles = angles.join(widest.select(*group, F.col("pivot").alias(end), F.col("radius").alias(f"r{end}")), [*group, end])
    angles = materialize(angles.where(F.col("apart") - F.col("rp") - F.col("rq") <= reach), "near-cells", plain=True)
    for end in ("p", "q"):
        side = tiles.select(*group, F.col("pivot").alias(end), F.col("radius").alias(f"own_{end}"), F.col("tile").alias(f"tile_{end}"))
        angles = angles.join(side, [*group, end])
    fits = F.col("apart") - F.col("own_p") - F.col("own_q") <= reach
    ordered = F.col("tile_p") <= F.col("tile_q")
    one_title = F.col("tile_p.heavy").isNotNull() & (F.col("tile_p.heavy") == F.col("tile_q.heavy"))
    kept = angles.where(fits & ((F.col("p") < F.col("q")) | ordered) & ~F.coalesce(one_title, F.lit(False)))
    return kept.select(*group, F.col("tile_p").alias("low"), F.col("tile_q").alias("high"))


def _bundles(sizes: DataFrame, group: list[str]) -> DataFrame:
    """Tiles packed into bundles: the largest first, each of BUNDLE_ROWS or more in a bundle of its own."""
    before = Window.partitionBy(*group).orderBy(F.desc("n"), "tile").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*group, "tile", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / BUNDLE_ROWS).cast("int").alias("bundle"))


def pivot_tiles(items: DataFrame, group: list[str], ident: str, rows: int, least_cosine: float) -> DataFrame:
    """Rows of groups larger than a tile, placed into the pairs (low, high) of bundles they have to be compared in.

    ``items`` has ``node``, ``copies`` and ``embedding``, of a length. Adds tile (the bundle of a row), low and high; each
    unordered pair of bundles with a pair of tiles that the bound does not rule out occurs once. Tiles smaller than a
    bundle share one, so that their number, whose square the pairs are, does not depend on how small ``rows`` is."""
    most = max(rows, BUNDLE_ROWS)
    cells, pivots = pivot_cells(items, group, ident, rows)
    cells = cells.withColumn("heavy", F.when(F.col("copies") > most, F.col("node")))
    pairs = materialize(tile_pairs(cells, pivots, group, most, least_cosine), "tile-pairs", plain=True)
    cell = [*group, "pivot", "heavy"]
    sizes = cells.groupBy(*cell).agg(F.ceil(F.count("*") / most).cast("int").alias("_parts"))
    a, b = cells.alias("a"), materialize(sizes, "cell-sizes", plain=True).alias("b")
    joined = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cell]).select("a.*", "b._parts")
    tiled = joined.withColumn("tile", F.struct("pivot", "heavy", tile_of(ident, "_parts").alias("part"))).drop("_parts", "pivot", "angle", "heavy")
    # Counted as rows fall into them: a part may be empty.
    counted = tiled.groupBy(*group, "tile").agg(F.count("*").alias("n"))
    bundles = materialize(_bundles(counted, group), "bundles", plain=True)

    def same(left: str, right: str, names: list[tuple[str, str]]) -> list[Column]:
        return [F.col(f"{left}.{x}").eqNullSafe(F.col(f"{right}.{y}")) for x, y in [*zip(group, group), *names]]

    ends = pairs.alias("p").join(bundles.alias("l"), same("p", "l", [("low", "tile")])).join(bundles.alias("h"), same("p", "h", [("high", "tile")]))
    low, high = F.least("l.bundle", "h.bundle").alias("low"), F.greatest("l.bundle", "h.bundle").alias("high")
    ends = materialize(ends.select(*[f"p.{c}" for c in group], low, high).distinct(), "bundle-pairs", plain=True)
    placed = tiled.alias("t").join(bundles.alias("b"), same("t", "b", [("tile", "tile")])).select("t.*", "b.bundle").drop("tile").withColumnRenamed("bundle", "tile")
    sides = ends.select(*group, F.explode(F.array_distinct(F.array("low", "high"))).alias("tile"), "low", "high")
    return placed.alias("l").join(sides.alias("r"), same("l", "r", [("tile", "tile")])).select("l.*", "r.low", "r.high")
