"""Exact top-k search by inner product over vector approximations."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.blocks import list_parts
from factloom.operators.ranking import top_k
from factloom.session import materialize

#: Cells that a vector's own range is cut into; a cell number is a byte.
CELLS = 256
#: Queries that a task holds, and candidates that pass by it.
QUERY_TILE, CHUNK = 4096, 1 << 20
#: Candidates of a chunk whose bounds are computed at once, and queries.
BLOCK, QUERY_STEP = 4096, 512
#: Pairs whose exact scores are computed at once.
PAIRS = 1 << 17
LOWEST = np.iinfo(np.int64).min
_KEYS = ["h1", "h2", "ints"]


def integer_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """(row, vec_id, ints) of the usable rows: floor(scale * x) of each component."""
    vec = F.col("embedding")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = vectors.select("vec_id", "embedding", F.monotonically_increasing_id().alias("row"))
    usable = usable.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    ints = F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    rows = usable.select("row", "vec_id", ints.alias("ints"))
    return rows.withColumns({"h1": F.xxhash64("ints"), "h2": F.xxhash64(F.lit("vector"), "ints")})


def vector_classes(rows: DataFrame, most: int) -> DataFrame:
    """One node for each distinct vector: (node, h1, h2, ints, members), the ``most`` rows with the smallest ids."""
    first = top_k(rows, _KEYS, [F.asc("vec_id"), F.asc("row")], most)
    members = F.sort_array(F.collect_list(F.struct("vec_id", "row")))
    return first.groupBy(*_KEYS).agg(members.alias("members")).withColumn("node", F.monotonically_increasing_id())


def approximated(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, step, cells) of each row: component d lies in low + step * cell .. low + step * cell + step - 1."""
    if not ints.shape[1]:
        return np.zeros(len(ints), np.int64), np.ones(len(ints), np.int64), ints.astype(np.uint8)
    low = ints.min(1)
    step = (ints.max(1) - low) // CELLS + 1
    return low, step, ((ints - low[:, None]) // step[:, None]).astype(np.uint8)


def approximation_file(classes: DataFrame) -> DataFrame:
    """(node, first_id, dim, width, low, step, cells, exact): cells as bytes, and the exact components beside them
    in a column of its own, ``width`` bytes each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = list_parts(batch.column("ints"))
            dims = np.diff(at)
            low, step, width = np.zeros(len(batch), np.int64), np.ones(len(batch), np.int64), np.zeros(len(batch), np.int32)
            cells, exact = [b""] * len(batch), [b""] * len(batch)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                ints = values[(at[rows][:, None] + np.arange(dim)).ravel()].astype(np.int64).reshape(len(rows), dim)
                if ints.size and (ints.min() <= -(1 << 31) or ints.max() >= 1 << 31):
                    raise OverflowError("components beyond 31 bits")
                low[rows], step[rows], codes = approximated(ints)
                large = np.abs(ints).max(1, initial=0)
                width[rows] = np.where(large < 1 << 15, 2, 4)
                for i, code, own, size in zip(rows.tolist(), codes, ints, width[rows].tolist(), strict=True):
                    cells[i], exact[i] = code.tobytes(), own.astype(f"<i{size}").tobytes()
            arrays = [batch.column("node"), batch.column("first_id"), pa.array(dims.astype(np.int32)), pa.array(width)]
            arrays += [pa.array(low), pa.array(step), pa.array(cells, pa.binary()), pa.array(exact, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, _FILE)

    listed = classes.select("node", F.col("members")[0]["vec_id"].alias("first_id"), "ints")
    return listed.mapInArrow(run, "node long, first_id long, dim int, width int, low long, step long, cells binary, exact binary")


_FILE = ["node", "first_id", "dim", "width", "low", "step", "cells", "exact"]


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column, one row after the other."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


class Approximations:
    """Candidates of one length; exact components are decoded only for those asked for."""

    def __init__(self, batch: pa.RecordBatch, dim: int):
        self.node, self.first_id, self.low, self.step, self.width = (
            batch.column(c).to_numpy().astype(np.int64) for c in ("node", "first_id", "low", "step", "width")
        )
        self.cells = _bytes(batch.column("cells")).reshape(len(batch), dim)
        self.data, self.dim = _bytes(batch.column("exact")), dim
        self.at = np.cumsum(self.width * dim) - self.width * dim

    def exact(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.dim), np.int64)
        for width in np.unique(self.width[rows]).tolist():
            of_width = np.flatnonzero(self.width[rows] == width)
            places = self.at[rows[of_width]][:, None] + np.arange(self.dim * width)
            out[of_width] = self.data[places].view(f"<i{width}").astype(np.int64)
        return out


class Search:
    """The best candidates so far of the queries of a tile, all of one length."""

    def __init__(self, queries: Approximations, most: int):
        self.node, self.q = queries.node, queries.exact(np.arange(len(queries.node)))
        self.most = most
        self.score = np.full((len(self.q), most), LOWEST)
        self.id = np.full((len(self.q), most), np.iinfo(np.int64).max)
        self.found = np.full((len(self.q), most), -1)
        self.read = 0  # exact vectors read
        self.largest = int(np.abs(self.q).max(initial=0))

    def bounds(self, rows: slice, block: Approximations) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores, exact integers.

        With x between low + step * cell and step - 1 more, the score lies between low * sum(q) + step * (q . cell) and
        that, plus step - 1 times the negative, or the positive, components of q."""
        q = self.q[rows]
        widest = int((np.abs(block.low) + block.step * CELLS).max(initial=0))
        reach = self.largest * widest * max(1, block.dim)
        if reach >= 1 << 62:
            raise OverflowError("scores beyond 63 bits")
        kind = np.float32 if self.largest * CELLS * max(1, block.dim) < 1 << 24 else np.float64 if reach < 1 << 52 else np.int64
        dots = (q.astype(kind) @ block.cells.T.astype(kind)).astype(np.int64)
        base = q.sum(1)[:, None] * block.low + dots * block.step
        return base + np.minimum(q, 0).sum(1)[:, None] * (block.step - 1), base + np.maximum(q, 0).sum(1)[:, None] * (block.step - 1)

    def add(self, block: Approximations) -> None:
        for start in range(0, len(self.q), QUERY_STEP):
            self._add(slice(start, min(len(self.q), start + QUERY_STEP)), block)

    def _add(self, rows: slice, block: Approximations) -> None:
        lower, upper = self.bounds(rows, block)
        bar = self.score[rows, -1]
        if lower.shape[1] >= self.most:
            bar = np.maximum(bar, np.partition(lower, -self.most, axis=1)[:, -self.most])
        query, other = np.nonzero(upper >= bar[:, None])
        upper = upper[query, other]
        # In the order of the bounds, the most promising of each query first.
        order = np.lexsort((-upper, query))
        query, other, upper = query[order] + rows.start, other[order], upper[order]
        begins = np.searchsorted(query, np.arange(rows.start, rows.stop))
        rank = np.arange(len(query)) - begins[query - rows.start]
        at, size = 0, self.most
        while len(query):
            now = rank < at + size
            self._read(query[now], other[now], block)
            # A candidate at the bar itself may still win by its smaller id.
            open_ = ~now & (upper >= self.score[query, -1])
            query, other, upper, rank = query[open_], other[open_], upper[open_], rank[open_]
            at, size = at + size, size * 4

    def _read(self, query: np.ndarray, other: np.ndarray, block: Approximations) -> None:
        self.read += len(query)
        score = np.zeros(len(query), np.int64)
        for start in range(0, len(query), PAIRS):
            part = slice(start, start + PAIRS)
            score[part] = (self.q[query[part]] * block.exact(other[part])).sum(1)
        rows, place = np.unique(query, return_inverse=True)
        k = self.most
        q = np.concatenate([np.repeat(np.arange(len(rows)), k), place])
        s = np.concatenate([self.score[rows].ravel(), score])
        i = np.concatenate([self.id[rows].ravel(), block.first_id[other]])
        n = np.concatenate([self.found[rows].ravel(), block.node[other]])
        order = np.lexsort((i, ~s, q))  # ~s falls as s rises, without overflow
        begins = np.searchsorted(q[order], np.arange(len(rows)))
        best = order[(begins[:, None] + np.arange(k)).ravel()]
        self.score[rows], self.id[rows], self.found[rows] = (v[best].reshape(-1, k) for v in (s, i, n))

    def results(self) -> pa.RecordBatch:
        query, rank = np.nonzero(self.found >= 0)
        arrays = [self.node[query], self.found[query, rank], self.id[query, rank], self.score[query, rank]]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["query", "node", "first_id", "score"])


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], int, pa.RecordBatch]]:
    """((tile, chunk), kind, rows): runs of a sorted batch."""
    keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("tile", "chunk", "kind")])
    cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(batch)], strict=True):
        if end > start:
            tile, chunk, kind = keys[:, start].tolist()
            yield (tile, chunk), kind, batch.slice(start, end - start)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.take(pa.array(np.flatnonzero(dims == dim)))


def searched(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, chunk and kind: queries come first, then the candidates pass by, block by block."""
    now, asked, searches = None, [], None
    for batch in batches:
        for key, kind, rows in _parts(batch):
            if key != now:
                for s in (searches or {}).values():
                    yield s.results()
                now, asked, searches = key, [], None
            if kind == 0:
                asked.append(rows)
                continue
            if not asked:
                continue
            if searches is None:
                searches = {d: Search(Approximations(r, d), most) for d, r in _by_length(pa.concat_batches(asked))}
            for start in range(0, len(rows), BLOCK):
                for dim, block in _by_length(rows.slice(start, BLOCK)):
                    if dim in searches:
                        searches[dim].add(Approximations(block, dim))
    for s in (searches or {}).values():
        yield s.results()


def nearest_by_product(
    vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256, query_tile: int = QUERY_TILE, chunk: int = CHUNK
) -> DataFrame:
    """Of each query the ``k`` other vectors with the largest inner product of floor(scale * x): query_id, rank, vec_id, score.

    ``vectors`` has vec_id (a whole number) and embedding; ``queries`` has the vec_ids that ask. Ties go to the smaller vec_id. Vectors that are null or hold null or
    non-finite components, and rows without vec_id, take no part; vectors of different lengths are not
    compared; an empty vector has the product 0 with other empty ones. Rows that repeat a vec_id are vectors of their own,
    each asks for itself and finds the others. An empty table gives an empty result; other columns are ignored.
    Components beyond 31 bits or scores beyond 62 bits after scaling are an error.

    Each distinct vector is approximated by the cells of a grid over its own range: one byte a component, two
    numbers a vector. A task holds a tile of queries; a chunk of candidates passes by. The cells
    give integer bounds of all products at once; the exact components, a column of their own, are read in the order of the
    upper bound until the k-th score found is above the next bound. A task hands on k + 1 results a query, so no pairs are
    listed, also not within groups of near copies. Copies are one candidate and one query: k + 1 of them are enough.
    """
    most = k + 1
    rows = materialize(integer_vectors(vectors, scale), "integers")
    classes = materialize(vector_classes(rows, most), "classes")
    file = materialize(approximation_file(classes), "approximations")
    asked = rows.join(queries.select("vec_id").distinct(), "vec_id", "left_semi")
    asked = materialize(asked.join(classes.select(*_KEYS, "node"), _KEYS).select("row", F.col("vec_id").alias("query_id"), "node"), "asked")
    asking = materialize(asked.select("node").distinct().join(file, "node"), "asking")

    n, n_asking = file.count(), asking.count()
    tiles = max(1, -(-n_asking // query_tile))
    spread = min(-(-n // 2048), -(-4 * vectors.sparkSession.sparkContext.defaultParallelism // tiles))
    chunks = max(1, -(-n // chunk), spread)
    one_of = lambda count, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(count)).cast("int")
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = asking.select(one_of(tiles, 1).alias("tile"), each(chunks).alias("chunk"), F.lit(0).alias("kind"), *_FILE)
    right = file.select(each(tiles).alias("tile"), one_of(chunks, 2).alias("chunk"), F.lit(1).alias("kind"), *_FILE)
    dealt = left.unionByName(right).repartition(tiles * chunks, "tile", "chunk").sortWithinPartitions("tile", "chunk", "kind")
    found = dealt.mapInArrow(lambda b: searched(b, most), "query long, node long, first_id long, score long")

    best = top_k(found, ["query"], [F.desc("score"), F.asc("first_id")], most).select("query", "node", "score")
    hits = best.join(classes.select("node", F.explode("members").alias("m")), "node").select("query", "score", "m.vec_id", "m.row")
    order = [F.desc("score"), F.asc("vec_id"), F.asc("row")]
    hits = materialize(top_k(hits, ["query"], order, most).drop("rank"), "hits")
    own = asked.select(F.col("row").alias("asker"), "query_id", F.col("node").alias("query")).join(hits, "query")
    ranked = top_k(own.where("asker <> row"), ["asker"], order, k)
    return ranked.select(F.col("query_id").cast("long"), F.col("rank").cast("int"), F.col("vec_id").cast("long"), "score")
