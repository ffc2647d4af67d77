"""SimHash fingerprints, and near-duplicate groups by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.blocks import text_blocks, words
from factloom.operators.components import connected_components
from factloom.session import materialize

BITS = 64
TILE = 2048
SLICE_PAIRS = 1 << 18


def shingle_fingerprints(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints of lower-cased texts: bit b is set if over half of the shingle
    hashes have it. Fewer words than a shingle has: one shingle of all; no word: zero."""
    import xxhash

    flat, row = words(pc.ascii_lower(texts))
    counts = np.bincount(row, minlength=len(texts))
    prints = np.zeros(len(texts), np.uint64)
    if not len(flat):
        return prints
    hashed, rows = [], []
    starts = np.flatnonzero(row[: len(row) - shingle + 1] == row[shingle - 1 :]) if len(row) >= shingle else np.zeros(0, int)
    if len(starts):
        parts = [flat.take(pa.array(starts + k)) for k in range(shingle)]
        hashed.append(pc.binary_join_element_wise(*parts, " "))
        rows.append(row[starts])
    few = np.flatnonzero((counts > 0) & (counts < shingle))
    first = np.cumsum(counts) - counts
    if len(few):
        hashed.append(pa.array([" ".join(flat.slice(first[i], counts[i]).to_pylist()) for i in few], flat.type))
        rows.append(few)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, seed) for part in hashed for s in part.to_pylist()], np.uint64)
    at = np.concatenate(rows)
    order = np.argsort(at, kind="stable")
    h, at = h[order], at[order]
    docs, begin = np.unique(at, return_index=True)
    total = np.diff([*begin, len(at)])
    for b in range(BITS):
        ones = np.add.reduceat((h >> np.uint64(b)) & np.uint64(1), begin).astype(np.int64)
        prints[docs] |= (2 * ones > total).astype(np.uint64) << np.uint64(b)
    return prints


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            fp = shingle_fingerprints(block.column("__text"), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """Plane b holds bit b of all values, eight to a byte: shape (64, n / 8)."""
    octets = np.ascontiguousarray(fp.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(np.packbits(np.unpackbits(octets, axis=1, bitorder="little"), axis=0, bitorder="little").T)


def within_radius(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """For aligned values, whether at most ``radius`` bits differ.

    The planes of both sides are compared one by one. A bitwise counter per lane takes the
    differences up by carry-save addition; a lane that overflows ``radius`` is marked. A block of
    lanes is given up once all its lanes are marked.
    """
    n, block = len(left), 4096
    near = np.zeros(n, bool)
    digits = max(1, (radius + 1).bit_length())
    spare = (1 << digits) - 1 - radius  # start value: the counter overflows at radius + 1
    for start in range(0, n, block):
        stop = min(n, start + block)
        a, b = bit_planes(left[start:stop]), bit_planes(right[start:stop])
        full = np.full(a.shape[1], 255, np.uint8)
        counter = [full.copy() if spare >> d & 1 else np.zeros_like(full) for d in range(digits)]
        over = ~np.packbits(np.ones(stop - start, bool), bitorder="little")
        for plane in range(BITS):
            carry = a[plane] ^ b[plane]
            for d in range(digits):
                counter[d], carry = counter[d] ^ carry, counter[d] & carry
            over |= carry
            if plane % 8 == 7 and (over == 255).all():
                break
        near[start:stop] = np.unpackbits(~over, bitorder="little")[: stop - start].astype(bool)
    return near


def _bucket_pairs(prints: list[np.ndarray], tiles: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs within each bucket, a bounded slice at a time; a bucket of two tiles has those across only."""
    left, right, held = [], [], 0
    for fp, tile in zip(prints, tiles, strict=True):
        crossing = tile.min() != tile.max()
        for i in range(len(fp) - 1):
            others = fp[i + 1 :][tile[i + 1 :] != tile[i]] if crossing else fp[i + 1 :]
            left.append(np.full(len(others), fp[i]))
            right.append(others)
            held += len(others)
            if held >= SLICE_PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def spanning_links(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each value to the smallest one of its component, in place of all links."""
    values, codes = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = codes[: len(left)], codes[len(left) :]
    label = np.arange(len(values))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _links_in_buckets(radius: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, tiles = batch.column("fps"), batch.column("tiles")
            prints = [lists[i].values.to_numpy().view(np.uint64) for i in range(len(lists))]
            sides = [tiles[i].values.to_numpy() for i in range(len(tiles))]
            for left, right in _bucket_pairs(prints, sides):
                near = within_radius(left, right, radius)
                if near.any():
                    a, b = spanning_links(left[near].view(np.int64), right[near].view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def bands_for(count: int, radius: int) -> int:
    """Number of bands: buckets of random fingerprints hold a few values at any number of them.

    Of m bands at least m - radius agree between fingerprints within the radius, so the buckets are
    all choices of m - radius bands, with 64 (m - radius) / m bits each."""
    bands = radius + 1
    while bands < 16 and count > 4 << (BITS * (bands - radius) // bands):
        bands += 1
    return bands


def fingerprint_links(distinct: DataFrame, radius: int = 2, bands: int | None = None, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect exactly the values ``fp`` within ``radius`` bits of each other.

    Not all pairs: each bucket gives spanning links only. A bucket of more than ``tile`` values is
    compared as pairs of tiles, one task row for each pair, so no task holds a whole bucket.
    """
    bands = bands or bands_for(distinct.count(), radius)
    edges = [BITS * i // bands for i in range(bands + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    signed = [sum(c) - (1 << 64) if sum(c) >> 63 else sum(c) for c in combinations(masks, bands - radius)]
    keys = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(signed)]
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.choice", "key.value")

    large = dealt.groupBy("choice", "value").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    large = large.select("choice", "value", F.ceil(F.col("n") / tile).cast("int").alias("n_tiles"))
    dealt = dealt.join(large, ["choice", "value"], "left").withColumn("n_tiles", F.coalesce("n_tiles", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("n_tiles")).cast("int")
    dealt = dealt.withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    dealt = dealt.withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
    buckets = dealt.groupBy("choice", "value", "low", "high").agg(
        F.collect_list(F.struct("fp", "tile")).alias("members")
    )
    buckets = buckets.where(F.size("members") > 1).select("members.fp", "members.tile").toDF("fps", "tiles")
    return buckets.mapInArrow(_links_in_buckets(radius), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, bands: int | None = None, tile: int = TILE) -> DataFrame:
    """Near-duplicate groups: (doc_id, fp, component_id), one row per row of ``docs`` (doc_id, text).

    Documents whose fingerprints differ in at most ``radius`` bits are linked; component_id is the
    smallest doc_id reachable. Null, empty and blank texts have the fingerprint zero and are linked
    like others. Rows that repeat a doc_id are rows of the result; a null doc_id is never a
    component_id unless all its group has none. Other columns are ignored.

    Fingerprints are compared as distinct values: copies meet in an aggregate, and so cost nothing
    afterwards. Candidates share bands of bits (exact for the radius); the values of a bucket are
    compared bit-sliced. Components run on fingerprints, and the documents of one that a third of all
    rows may have are never gathered.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    links = materialize(fingerprint_links(distinct.select("fp"), radius, bands, tile), "near")
    labels = materialize(connected_components(links, []).select(F.col("node").alias("fp"), "component"), "labels")
    grouped = distinct.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = grouped.join(lowest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
