"""A vector index as two tables: lists of vectors around centroids, and the centroids with their radius.

Exact search reads, for each query, the most promising lists first. The k-th best score found there rules out every list whose
bound, the cosine of angle(query, centroid) - radius, lies below it; the others are read in a second step. Nothing
is lost. ``probes`` reads that many nearest lists instead, and ``index_recall`` tells what that loses.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.vectors import dot, norm
from factloom.operators.nearest import _best, _objects, _query_block, matrix, unit_rows
from factloom.operators.pivots import SLACK, pivot_cells
from factloom.operators.ranking import top_k
from factloom.session import materialize

#: A list of its own for all vectors of small tenants, and one for vectors without a length: always read.
WHOLE, NO_LENGTH = 0, -1
#: Vectors of lists that share a bundle, and of a part of it, and queries, that meet in one task.
BUNDLE_ROWS, PART_ROWS, QUERY_ROWS = 1 << 14, 1 << 17, 1 << 14
_QUERY = ["query_id", "user_id", "vec", "category"]


def build_index(vectors: DataFrame, path: str, list_rows: int = 20_000) -> None:
    """Write the index of ``vectors`` (user_id, id, category, embedding) below ``path``, which must be new.

    Tenants of more than ``list_rows`` vectors have about one list per half as many, at most 256; lists are
    folders, sorted by tenant, so that a search reads the folders it needs and skips other tenants' row groups."""
    vectors = vectors.where(F.col("embedding").isNotNull()).select("user_id", "id", "category", "embedding")
    measured = vectors.withColumn("_long", norm("embedding") > 0)
    usable = materialize(measured.where("_long").drop("_long"), "usable")
    cells, pivots = pivot_cells(usable, ["user_id"], "id", list_rows)
    cells = cells.withColumnRenamed("pivot", "list")
    small = usable.join(cells.select("user_id").distinct(), "user_id", "left_anti")
    always = F.lit(float(np.pi))
    parts = [
        cells,
        small.withColumns({"list": F.lit(WHOLE), "angle": always}),
        measured.where("not _long").drop("_long").withColumns({"list": F.lit(NO_LENGTH), "angle": always}),
    ]
    listed = materialize(parts[0].unionByName(parts[1]).unionByName(parts[2]), "listed")
    stored = listed.drop("angle").repartitionByRange("list", "user_id", "id").sortWithinPartitions("list", "user_id", "id")
    stored.write.partitionBy("list").mode("error").parquet(f"{path}/lists")
    sizes = listed.groupBy("user_id", "list").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    centers = pivots.select("user_id", F.col("pivot").alias("list"), F.col("unit").alias("center"))
    sizes.join(centers, ["user_id", "list"], "left").write.mode("error").parquet(f"{path}/centroids")


def list_bounds(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """For each query and list of its tenant: query_id, user_id, list, n, angle and bound, the most a cosine can be."""
    length = norm("vec")
    unit = F.when(length > 0, F.transform("vec", lambda x: x.cast("double") / length))
    asked = queries.select("query_id", "user_id", unit.alias("unit"))
    met = asked.join(centroids, "user_id")
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("unit", "center")))
    # A list without a centroid, and a query without a length, rule nothing out; such a list is the last to be near.
    known = F.col("center").isNotNull() & F.col("unit").isNotNull()
    angle = F.when(known, F.acos(cosine)).otherwise(F.lit(float(np.pi)))
    gap = F.when(known, F.greatest(F.lit(0.0), angle - F.col("radius") - SLACK)).otherwise(0.0)
    return met.select("query_id", "user_id", "list", "n", angle.alias("angle"), F.cos(gap).alias("bound"))


def _passing(batches: Iterable[pa.RecordBatch], min_score: float, fetch: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by place, kind and list: the queries of a place come first, then its vectors pass by, list by list."""

    def results(kept: list[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        if sum(map(len, kept)):
            best = _best(pd.concat(kept, ignore_index=True), fetch)
            yield pa.RecordBatch.from_arrays([pa.array(best[f.name].tolist(), f.type) for f in out], schema=out)

    now, asked, block, asking, kept, limit = None, [], None, {}, [], 0
    for batch in batches:
        runs = list(zip(*(batch.column(c).to_pylist() for c in ("place", "kind", "list")), strict=True))
        cuts = [i for i in range(1, len(runs)) if runs[i] != runs[i - 1]]
        for start, end in zip([0, *cuts], [*cuts, len(runs)], strict=True):
            if end <= start:
                continue
            part, (place, kind, number) = batch.slice(start, end - start), runs[start]
            if place != now:
                yield from results(kept)
                now, asked, block, kept, limit = place, [], None, [], 0
            if kind == 0:
                asked.append(part)
                continue
            if not asked:
                continue
            if block is None:
                table = pa.Table.from_batches(asked)
                block, wanted = _query_block(table), table.column("lists").combine_chunks()
                numbers, row = wanted.flatten().to_numpy(), wanted.value_parent_indices().to_numpy()
                order = np.argsort(numbers, kind="stable")
                values, first = np.unique(numbers[order], return_index=True)
                asking = dict(zip(values.tolist(), np.split(row[order], first[1:]), strict=True))
            if number not in asking:
                continue
            vectors, categories = unit_rows(matrix(part.column("vec"))), np.array(part.column("category").to_pylist(), dtype=object)
            kept.append(block.only(asking[number]).hits(_objects(part.column("id")), vectors, categories, min_score, fetch))
            if sum(map(len, kept)) > max(2 * limit, 100_000):
                kept = [_best(pd.concat(kept, ignore_index=True), fetch)]
                limit = len(kept[0])
    yield from results(kept)


def _bundles(probes: DataFrame, rows: int) -> DataFrame:
    """Lists packed into bundles of about ``rows`` vectors: user_id, list, bundle, n. A tenant has few hundred lists."""
    lists = probes.groupBy("user_id", "list").agg(F.max("n").alias("n"))
    before = Window.partitionBy("user_id").orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    return lists.withColumn("bundle", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / rows).cast("int"))


def _scored(lists: DataFrame, queries: DataFrame, probes: DataFrame, min_score: float, fetch: int) -> DataFrame:
    """Hits (query_id, id, score) of the pairs ``probes`` (query_id, user_id, list, n); several rows of a query add up.

    A query travels once to each bundle of lists it asks for, not once to each list, with the numbers of the lists."""
    place = ["user_id", "bundle"]
    bundles = materialize(_bundles(probes, BUNDLE_ROWS), "bundles")
    wants = probes.join(bundles.drop("n"), ["user_id", "list"]).groupBy("query_id", *place)
    wants = materialize(wants.agg(F.collect_set(F.col("list").cast("int")).alias("lists")), "wanted-lists")
    sizes = wants.groupBy(*place).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("tiles"))
    parts = bundles.groupBy(*place).agg(F.ceil(F.sum("n") / PART_ROWS).cast("int").alias("parts"))
    sizes = materialize(sizes.join(parts, place), "probed-bundles")

    def one(count: str, ident: str):
        return F.pmod(F.xxhash64(ident), F.col(count)).cast("int")

    def each(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    kinds = {queries.schema["vec"].dataType.simpleString(), lists.schema["embedding"].dataType.simpleString()}
    kind = kinds.pop() if len(kinds) == 1 else "array<double>"
    named = F.to_json(F.struct(*place, "part", "tile")).alias("place")
    asked = wants.join(sizes, place).join(queries.select(*_QUERY), ["query_id", "user_id"])
    asked = asked.withColumn("tile", one("tiles", "query_id")).withColumn("part", each("parts"))
    asked = asked.select(named, F.lit(0).alias("kind"), "query_id", F.col("vec").cast(kind).alias("vec"), "category", "lists")
    read = lists.join(bundles.drop("n"), ["user_id", "list"]).join(sizes, place)
    read = read.withColumn("part", one("parts", "id")).withColumn("tile", each("tiles")).withColumn("list", F.col("list").cast("int"))
    read = read.select(named, F.lit(1).alias("kind"), "id", F.col("embedding").cast(kind).alias("vec"), "category", "list")
    dealt = asked.unionByName(read, allowMissingColumns=True).repartition("place").sortWithinPartitions("place", "kind", "list")
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("id", lists.schema["id"].dataType)]
    out = T.StructType([*fields, T.StructField("score", T.DoubleType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    return dealt.mapInArrow(lambda batches: _passing(batches, min_score, fetch, arrow), out)


def search_index(
    spark: SparkSession, path: str, queries: DataFrame, fetch: int, min_score: float, probes: int | None = None, first: int = 2
) -> DataFrame:
    """As ``nearest.nearest`` on the indexed vectors: query_id, id, score, rank.

    Exact, unless ``probes`` gives the number of nearest lists to read for a query. ``first`` lists are read before the others are judged."""
    lists, centroids = spark.read.parquet(f"{path}/lists"), spark.read.parquet(f"{path}/centroids")
    queries = materialize(queries.where(F.col("vec").isNotNull()).select(*_QUERY), "asked")
    bounds = materialize(list_bounds(queries, centroids).where(F.col("bound") >= min_score - SLACK), "bounds")
    nearest_first = [F.asc("angle"), F.asc("list")]
    order = [F.desc("bound"), *nearest_first] if probes is None else nearest_first
    ranked = top_k(bounds, ["query_id"], order, first if probes is None else probes)
    found = materialize(_scored(lists, queries, ranked, min_score, fetch), "first-hits")
    best = [F.desc("score"), F.asc("id")]
    if probes is None:
        top = top_k(found, ["query_id"], best, fetch)
        # Scores are rounded, so a list is ruled out only clearly below the last one.
        bar = top.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("score").alias("last"))
        bar = bar.where(F.col("hits") >= fetch).select("query_id", "last")
        rest = bounds.join(ranked.select("query_id", "list"), ["query_id", "list"], "left_anti").join(bar, "query_id", "left")
        rest = rest.where(F.col("last").isNull() | (F.col("bound") >= F.col("last") - SLACK))
        rest = materialize(rest.select(*bounds.columns), "second-probes")
        found = found.unionByName(_scored(lists, queries, rest, min_score, fetch))
    return top_k(found, ["query_id"], best, fetch)


def index_recall(spark: SparkSession, path: str, queries: DataFrame, fetch: int, min_score: float, probes: int, sample: int = 256) -> float:
    """Share of the exact hits that ``probes`` lists find, for ``sample`` of the queries."""
    drawn = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    drawn = materialize(drawn, "recall-sample")
    exact = materialize(search_index(spark, path, drawn, fetch, min_score).select("query_id", "id"), "exact-hits")
    some = search_index(spark, path, drawn, fetch, min_score, probes).select("query_id", "id")
    there, found = exact.count(), exact.join(some, ["query_id", "id"], "left_semi").count()
    return found / there if there else 1.0
