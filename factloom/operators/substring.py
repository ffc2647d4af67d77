"""Exact substring join: which patterns occur in which texts.

A pattern contained in a text brings all of its own fixed-width pieces along, so one
piece per pattern (its *anchor*) turns ``contains`` into an equi-join that is verified
afterwards. Nothing is ever compared pair by pair, whatever the size of a tenant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.bloom import MOST_BITS, bloom_of, mixed
from factloom.operators.joins import by_sorting
from factloom.session import materialize

# Piece widths; a pattern uses the largest that fits, the empty pattern width 0.
WIDTHS = (1, 2, 4, 8, 16)
_POSITIONS_TRIED = 8
#: Beyond as many candidates neither they nor the texts are broadcast.
FEW = 100_000
_CHUNK_CHARS = 1_000_000
_PIECE = ["width", "piece"]
_PIECE_FIELDS = [T.StructField("width", T.IntegerType()), T.StructField("piece", T.LongType())]
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def piece_hashes(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``width``-character pieces: (index of the text, hash).

    ``width`` is a power of two; hashes of a doubled width come from two halves.
    """
    if width == 0:
        return np.arange(len(texts)), np.zeros(len(texts), dtype=np.int64)
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    hashed = np.frombuffer(joined, dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if hashed.size < width:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    factor, done = _MULTIPLIER, 1
    with np.errstate(over="ignore"):
        while done < width:
            hashed = hashed[:-done] * factor + hashed[done:]
            factor = factor * factor
            done *= 2
    inside = row[: hashed.size] == row[width - 1 :]
    return row[: hashed.size][inside], hashed[inside].view(np.int64)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, text in enumerate(texts):
        if i > start and chars + len(text) > _CHUNK_CHARS:
            yield start, i
            start, chars = i, 0
        chars += len(text)
    if start < len(texts):
        yield start, len(texts)


def _emit(
    batch: pa.RecordBatch, keep: list[str], rows: np.ndarray, width: int, hashes: np.ndarray
) -> pa.RecordBatch:
    taken = batch.select(keep).take(pa.array(rows))
    widths = pa.array(np.full(len(rows), width, dtype=np.int32))
    return pa.RecordBatch.from_arrays([*taken.columns, widths, pa.array(hashes)], names=[*keep, *_PIECE])


def _distinct_pairs(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(rows.size, dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[first], hashes[first]


def _anchors(patterns: DataFrame, scope: list[str]) -> DataFrame:
    """Per pattern the piece that the fewest other patterns of its scope share."""
    width = F.lit(0)
    for w in WIDTHS:
        width = F.when(F.length("pattern") >= w, w).otherwise(width)
    sized = patterns.select(*scope, "pattern").distinct().withColumn("width", width)
    keep = [*scope, "pattern"]
    schema = T.StructType([sized.schema[name] for name in keep] + _PIECE_FIELDS)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("pattern").to_pylist()
            widths = batch.column("width").to_numpy()
            for w in np.unique(widths):
                (of_width,) = np.nonzero(widths == w)
                part = [texts[i] for i in of_width]
                for lo, hi in _chunks(part):
                    rows, hashes = piece_hashes(part[lo:hi], int(w))
                    starts = np.searchsorted(rows, np.arange(hi - lo))
                    sizes = np.bincount(rows, minlength=hi - lo)
                    steps = np.linspace(0, 1, _POSITIONS_TRIED)[None, :]
                    picks = np.unique((starts[:, None] + np.round(steps * (sizes[:, None] - 1))).astype(np.int64))
                    rows, hashes = _distinct_pairs(rows[picks], hashes[picks])
                    yield _emit(batch, keep, of_width[lo + rows], int(w), hashes)

    pieces = sized.mapInArrow(split, schema)
    shared = pieces.groupBy(*scope, *_PIECE).agg(F.count("*").alias("shared_by"))
    return (
        pieces.join(shared, [*scope, *_PIECE])
        .groupBy(*scope, "pattern", "width")
        .agg(F.min_by("piece", F.struct("shared_by", "piece")).alias("piece"))
    )


def substring_matches(
    texts: DataFrame,
    patterns: DataFrame,
    scope: list[str],
    key: list[str],
    carry: list[str] | None = None,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """All (text, pattern) with ``pattern`` contained in ``text`` within equal ``scope``.

    ``texts`` has ``scope + key + carry + ['text']``, unique per ``scope + key``;
    ``patterns`` has ``scope + ['pattern']``. Comparison is exact; lower both sides
    beforehand to ignore case. The result has ``scope + key + carry + ['pattern']``.

    The anchors travel to the scan of the texts as a filter of bounded size, by scope, width and
    piece; only pieces it lets through leave the scan, without their texts. They meet their anchors in a
    join, and the candidates meet the texts: in place where they are few enough to be
    broadcast, else each text is moved once, and those without a candidate not at
    all where a runtime filter applies. One plan for any number of anchors.
    """
    carry = carry or []
    texts = texts.where(F.col("text").isNotNull()).select(*scope, *key, *carry, "text")
    patterns = patterns.where(F.col("pattern").isNotNull())
    anchors = _anchors(patterns, scope).withColumn("_scope", F.xxhash64(*scope))
    anchors = materialize(anchors, "anchors", plain=True)
    widths = sorted(r["width"] for r in anchors.select("width").distinct().collect())
    wanted = bloom_of(anchors, ["_scope", *_PIECE], most_bits)
    shared = texts.sparkSession.sparkContext.broadcast(wanted)
    keep = [*scope, *key]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings = batch.column("text").to_pylist()
            scopes = batch.column("_scope").to_numpy()
            for lo, hi in _chunks(strings):
                for width in widths:
                    rows, hashes = piece_hashes(strings[lo:hi], width)
                    hit = shared.value.has(mixed(scopes[lo + rows], np.full(len(rows), width, np.int64), hashes))
                    rows, hashes = _distinct_pairs(rows[hit], hashes[hit])
                    yield _emit(batch, keep, lo + rows, width, hashes)

    fields = [texts.schema[name] for name in keep]
    scanned = texts.select(*keep, "text", F.xxhash64(*scope).alias("_scope"))
    hits = scanned.mapInArrow(scan, T.StructType(fields + _PIECE_FIELDS))
    candidates = hits.join(anchors.drop("_scope"), [*scope, *_PIECE]).select(*keep, "pattern").distinct()
    candidates = materialize(candidates, "candidates", plain=True)
    if candidates.count() > FEW:
        texts = by_sorting(texts)
    same = [F.col(f"t.{c}") == F.col(f"c.{c}") for c in scope] + [F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}")) for c in key]
    found = texts.alias("t").join(candidates.alias("c"), same).where(F.contains("t.text", "c.pattern"))
    return found.select(*[f"t.{c}" for c in [*scope, *key, *carry]], "c.pattern")
