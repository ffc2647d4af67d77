"""Exact filtered nearest neighbours by cosine, for a table of queries at once."""

from __future__ import annotations

from collections.abc import Container, Iterator
from copy import copy

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.ranking import top_k
from factloom.operators.tiling import cross_tiles
from factloom.session import materialize

# Scores are ranked at this many decimals: equal vectors must tie whatever the order
# in which a matrix product happened to add up.
SCORE_DECIMALS = 9
_QUERY_STEP = 512
#: Scores held at once by a task: each takes up to a hundred bytes while the best are picked.
_SCORES = 1 << 19
#: Smaller tiles than this cost more to send, once for each tile of the other side, than to score.
LEAST_TILE = 8192


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of an Arrow list column as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def rows_by_key(table: pa.Table | pa.RecordBatch, names: list[str], wanted: Container) -> Iterator[tuple]:
    """(key, its rows) for every key of the table that is wanted; a single column gives plain keys."""
    columns = [table.column(name).to_pylist() for name in names]
    keys = pd.Series(columns[0] if len(names) == 1 else list(zip(*columns)), dtype=object)
    codes, values = pd.factorize(keys)
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(values) + 1))
    for n, key in enumerate(values):
        if key in wanted:
            yield key, table.take(pa.array(order[ends[n] : ends[n + 1]]))


def unit_rows(m: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(lengths == 0, 1.0, lengths)


def _codes(values: np.ndarray, known: dict) -> np.ndarray:
    return np.array([known.get(v, -1) for v in values], dtype=np.int64)


class _QueryBlock:
    """Queries of one tenant as a matrix."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, categories: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.known = {c: i for i, c in enumerate(sorted({c for c in categories if c is not None}))}
        self.category = _codes(categories, self.known)

    def only(self, rows: np.ndarray) -> _QueryBlock:
        """The queries of some rows."""
        part = copy(self)
        part.ids, part.vectors, part.category = self.ids[rows], self.vectors[rows], self.category[rows]
        return part

    def hits(
        self, ids: np.ndarray, vectors: np.ndarray, categories: np.ndarray, min_score: float, fetch: int
    ) -> pd.DataFrame:
        category = _codes(categories, self.known)
        parts = []
        step = max(1, min(_QUERY_STEP, _SCORES // max(len(ids), 1)))
        for start in range(0, len(self.ids), step):
            stop = start + step
            scores = self.vectors[start:stop] @ vectors.T
            q, f = np.divmod(np.flatnonzero(scores >= min_score - 10.0**-SCORE_DECIMALS), max(scores.shape[1], 1))
            score, wanted = np.round(scores[q, f], SCORE_DECIMALS), self.category[start + q]
            keep = (score >= min_score) & ((wanted < 0) | (wanted == category[f]))
            part = pd.DataFrame({"query_id": self.ids[start + q[keep]], "id": ids[f[keep]], "score": score[keep]})
            parts.append(_best(part, fetch) if len(part) > fetch * len(scores) else part)
        return pd.concat(parts, ignore_index=True)


def _best(hits: pd.DataFrame, fetch: int) -> pd.DataFrame:
    ordered = hits.sort_values(["query_id", "score", "id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(fetch)


def _objects(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_pandas().to_numpy()


def _query_block(table: pa.Table) -> _QueryBlock:
    categories = np.array(table.column("category").to_pylist(), dtype=object)
    return _QueryBlock(_objects(table.column("query_id")), unit_rows(matrix(table.column("vec"))), categories)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    fetch: int,
    min_score: float,
    broadcast_bytes: int = 64 << 20,
    broadcast_rows: int = 20_000,
    tile_rows: int = 16_384,
) -> DataFrame:
    """Per query the ``fetch`` most similar vectors of its tenant with cosine >= ``min_score``.

    ``vectors``: user_id, id, category, embedding. ``queries``: query_id, user_id, vec,
    category (null = any). Returns query_id, id, score, rank.

    Queries that fit ``broadcast_rows`` and ``broadcast_bytes`` go to every task and the
    vectors are scanned where they lie, keeping a running top list per task. A larger
    batch is tiled on both sides: a task sees one tile of vectors and one tile of
    queries of one tenant, so a tenant of any size spreads over many tasks. There, equal
    vectors are scored once where at least half of them are copies.
    """
    vectors = vectors.where(F.col("embedding").isNotNull()).select("user_id", "id", "category", "embedding")
    queries = queries.where(F.col("vec").isNotNull()).select("query_id", "user_id", "vec", "category")
    out = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", vectors.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    head = queries.limit(broadcast_rows + 1).toArrow()
    if head.num_rows <= broadcast_rows and head.nbytes <= broadcast_bytes:
        found = _scan(vectors, head, fetch, min_score, out)
    else:
        found = _of_classes(vectors, queries, fetch, min_score, max(tile_rows, LEAST_TILE), out)
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("id")], fetch)


def _scan(vectors: DataFrame, queries: pa.Table, fetch: int, min_score: float, out: T.StructType) -> DataFrame:
    users = set(queries.column("user_id").to_pylist()) - {None}
    blocks = {user: _query_block(part) for user, part in rows_by_key(queries, ["user_id"], users)}
    shared = vectors.sparkSession.sparkContext.broadcast(blocks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, limit = None, 0
        arrow_schema = None
        for batch in batches:
            arrow_schema = batch.schema
            for user, mine in rows_by_key(batch, ["user_id"], shared.value):
                block = shared.value[user]
                hits = block.hits(
                    _objects(mine.column("id")),
                    unit_rows(matrix(mine.column("embedding"))),
                    np.array(mine.column("category").to_pylist(), dtype=object),
                    min_score,
                    fetch,
                )
                kept = hits if kept is None else pd.concat([kept, hits], ignore_index=True)
                if len(kept) > max(2 * limit, 100_000):
                    kept = _best(kept, fetch)
                    limit = len(kept)
        if kept is not None and len(kept):
            best = _best(kept, fetch)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(best["query_id"].tolist(), queries.schema.field("query_id").type),
                    pa.array(best["id"].tolist(), arrow_schema.field("id").type),
                    pa.array(best["score"].to_numpy()),
                ],
                names=["query_id", "id", "score"],
            )

    return vectors.mapInArrow(scan, out)


def _classes(df: DataFrame, ident: str, vector: str) -> tuple[DataFrame, DataFrame | None]:
    """(one row per tenant, category and vector, with the smallest id; its members: class, id), or the rows themselves
    and nothing if fewer than half of them are copies."""
    key = ["user_id", "category", vector]
    df = materialize(df, "class-rows")
    n, kinds = df.agg(F.count("*"), F.approx_count_distinct(F.xxhash64(*key))).first()
    if kinds > n / 2:
        return df, None
    reps = materialize(df.groupBy(*key).agg(F.min(ident).alias(ident)), "classes", plain=True)
    a, b = df.alias("a"), reps.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in key]
    members = a.join(b, same).select(F.col(f"b.{ident}").alias("class"), F.col(f"a.{ident}").alias("member"))
    return reps.select(*df.columns), materialize(members, "members", plain=True)


def _of_classes(
    vectors: DataFrame, queries: DataFrame, fetch: int, min_score: float, tile_rows: int, out: T.StructType
) -> DataFrame:
    """Classes of equal vectors against classes of equal queries. The first ``fetch`` hits lie in the first ``fetch``
    classes by score and smallest id, and are among the ``fetch`` smallest ids of each."""
    vectors, of_vector = _classes(vectors, "id", "embedding")
    queries, of_query = _classes(queries, "query_id", "vec")
    found = _tiled(vectors, queries, fetch, min_score, tile_rows, out)
    if of_vector is not None:
        found = top_k(found, ["query_id"], [F.desc("score"), F.asc("id")], fetch).drop("rank")
        first = top_k(of_vector, ["class"], [F.asc("member")], fetch).drop("rank")
        found = found.join(first, F.col("id") == F.col("class")).select("query_id", F.col("member").alias("id"), "score")
    if of_query is not None:
        found = top_k(found, ["query_id"], [F.desc("score"), F.asc("id")], fetch).drop("rank")
        found = materialize(found, "class-hits", plain=True)
        found = found.join(of_query, F.col("query_id") == F.col("class")).select(F.col("member").alias("query_id"), "id", "score")
    return found


def _tiled(
    vectors: DataFrame, queries: DataFrame, fetch: int, min_score: float, tile_rows: int, out: T.StructType
) -> DataFrame:
    left, right = cross_tiles(vectors, queries, ["user_id"], "id", "query_id", tile_rows)
    keys = ["user_id", "l_tile", "r_tile"]

    def score(v: pa.Table, q: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        types = [q.schema.field("query_id").type, v.schema.field("id").type, pa.float64()]
        if v.num_rows == 0 or q.num_rows == 0:
            return pa.table([pa.array([], t) for t in types], names=names)
        categories = np.array(v.column("category").to_pylist(), dtype=object)
        hits = _query_block(q).hits(
            _objects(v.column("id")), unit_rows(matrix(v.column("embedding"))), categories, min_score, fetch
        )
        best = _best(hits, fetch)
        return pa.table([pa.array(best[n].tolist(), t) for n, t in zip(names, types)], names=names)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, out)
