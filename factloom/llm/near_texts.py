"""Near-duplicate texts: candidates by SimHash fingerprints and by MinHash bands, then exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.blocks import carried, coded, list_array, list_parts, text_blocks, whole_groups, words
from factloom.llm.simhash import simhash_groups
from factloom.operators.bloom import Bloom, bloom_of, mixed
from factloom.operators.components import connected_components
from factloom.session import materialize

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s^6)^40: 0.999995 at 0.8, 0.03 at 0.3.
BANDS, BAND_ROWS = 40, 6
#: Bounds of a tile: texts, and shingles of all its texts.
TILE, TILE_SHINGLES = 2048, 1 << 20
#: Shingles whose minima are taken at once.
CHUNK = 1 << 16
BLOCK_BYTES = 1_500_000
#: Bits at most of a filter of band keys or rows (16 MB).
FILTER_BITS = 1 << 27


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit values that scatters them (the finalizer of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit hashes of the shingles of each lower-cased text, ascending, and where each text begins and
    ends in them. Fewer words than a shingle has: one shingle of all; no word: none."""
    import xxhash

    flat, row = words(pc.ascii_lower(texts))
    counts = np.bincount(row, minlength=len(texts)).astype(np.int64)
    codes, distinct = coded(flat)
    digest = xxhash.xxh64_intdigest
    word = np.array([digest(w) for w in distinct.to_pylist()], np.uint64)[codes]
    first = np.cumsum(counts) - counts
    length = np.minimum(counts, shingle)
    starts = np.flatnonzero(np.arange(len(word)) - first[row] <= (counts - length)[row])
    h = length[row[starts]].astype(np.uint64)
    for k in range(shingle):
        inside = k < length[row[starts]]
        h[inside] = _mixed(h[inside] * np.uint64(0x9E3779B97F4A7C15) + word[starts[inside] + k])
    order = np.lexsort((h, row[starts]))
    h, at = h[order], row[starts][order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(at[new], minlength=len(texts)))]).astype(np.int64)


def band_keys(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, keys) of each set: a hash of the whole set, and one of the minima of each band."""
    n = len(at) - 1
    full = np.flatnonzero(np.diff(at))
    node, keys = np.zeros(n, np.uint64), np.zeros((n, BANDS), np.uint64)
    if len(full):
        node[full] = np.add.reduceat(_mixed(hashes), at[full])
        node = _mixed(node + np.diff(at).astype(np.uint64))
        odd = _mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64))
        lowest = np.full((BANDS * BAND_ROWS, n), np.iinfo(np.uint64).max, np.uint64)
        owner = np.repeat(np.arange(n), np.diff(at))
        for start in range(0, len(hashes), CHUNK):
            part, own = hashes[start : start + CHUNK], owner[start : start + CHUNK]
            begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sets = own[begin]
            for f, salt in enumerate(odd):
                # The upper bits of a product with an odd number, after a salt, order the shingles anew.
                value = (part ^ salt) * (salt | np.uint64(1))
                value ^= value >> np.uint64(32)
                value *= np.uint64(0xC4CEB9FE1A85EC53)
                lowest[f, sets] = np.minimum(lowest[f, sets], np.minimum.reduceat(value, begin))
        for b in range(BANDS):
            key = np.full(n, b + 1, np.uint64)
            for f in range(BAND_ROWS):
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + lowest[b * BAND_ROWS + f])
            keys[:, b] = key
    return node, keys


def signatures(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """``carry``, node and keys (none for a text without words) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            hashes, at = shingle_sets(block.column("__text"))
            node, keys = band_keys(hashes, at)
            sizes = np.where(np.diff(at) > 0, BANDS, 0)
            lists = list_array(keys[sizes > 0].ravel().view(np.int64), sizes, pa.int64())
            columns = [block.column(c) for c in carry]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(node.view(np.int64)), lists], [*carry, "node", "keys"])

    return docs.mapInArrow(run, f"{carried(docs, carry)}, node long, keys array<long>")


def similar_pairs(hashes: np.ndarray, at: np.ndarray, side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that connect exactly what pairs of Jaccard similarity >= ``threshold`` connect.

    With two sides only pairs across are compared. A set is compared with all others at once, by the lists of
    sets that hold its shingles, unless all of them are connected with it already."""
    n, sizes = len(at) - 1, np.diff(at)
    _, codes = np.unique(hashes, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(codes, kind="stable")
    holders = owner[order]
    ends = np.cumsum(np.bincount(codes))
    begins = np.concatenate([[0], ends[:-1]])
    crossing = side.min() != side.max()
    label, left, right = np.arange(n), [], []
    for i in np.flatnonzero(side == side.min()) if crossing else range(n - 1):
        others = side != side[i] if crossing else np.arange(n) > i
        others &= label != label[i]
        if not others.any():
            continue
        own = codes[at[i] : at[i + 1]]
        own = own[ends[own] - begins[own] > 1]
        if not len(own):
            continue
        shared = np.bincount(np.concatenate([holders[begins[c] : ends[c]] for c in own]), minlength=n)
        found = np.flatnonzero(others & (shared / (sizes + sizes[i] - shared) >= threshold))
        if len(found):
            left += [i] * len(found)
            right += found.tolist()
            label[np.isin(label, label[found])] = label[i]
    return np.array(left, np.int64), np.array(right, np.int64)


def _verified(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for batch, bounds in whole_groups(batches, ["low", "high"]):
        node, tile = batch.column("node").to_numpy(), batch.column("tile").to_numpy()
        hashes, at = list_parts(batch.column("hashes"))
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            if end - start > 1:
                own = hashes[at[start] : at[end]]
                a, b = similar_pairs(own, at[start : end + 1] - at[start], tile[start:end], threshold)
                ids = node[start:end]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], ["a", "b"])


def verified_links(sets: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """Links (a, b) among the sets (component, node, hashes) of each component, compared exactly.

    A component of more than a tile is compared as pairs of tiles, so no task holds all of it."""
    size = F.greatest(F.count("*") / tile, F.sum(F.size("hashes")) / TILE_SHINGLES)
    sizes = sets.groupBy("component").agg(F.ceil(size).cast("int").alias("tiles"))
    sizes = materialize(sizes, "sizes")
    rows = sets.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tile_of, other = F.xxhash64("component", "part"), F.xxhash64("component", "other")
    rows = rows.select("node", "hashes", tile_of.alias("tile"), F.least(tile_of, other).alias("low"), F.greatest(tile_of, other).alias("high"))
    dealt = rows.repartition("low", "high").sortWithinPartitions("low", "high")
    return dealt.mapInArrow(lambda batches: _verified(batches, threshold), "a long, b long")


def keys_in(nodes: DataFrame, wanted: Bloom) -> DataFrame:
    """(node, key): the band keys that ``wanted`` may have. Nearly all keys have one node; these stay where they are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at = list_parts(batch.column("keys"))
            node = np.repeat(batch.column("node").to_numpy(), np.diff(at))
            found = wanted.has(mixed(keys))
            yield pa.RecordBatch.from_arrays([pa.array(node[found], pa.int64()), pa.array(keys[found], pa.int64())], ["node", "key"])

    return nodes.select("node", "keys").mapInArrow(run, "node long, key long")


def row_in(wanted: Bloom) -> Column:
    """Whether ``wanted`` may have the row: only its key goes to Python, not its text."""

    @F.arrow_udf("boolean")
    def has(row: pa.Array) -> pa.Array:
        return pa.array(wanted.has(mixed(row.to_numpy())))

    return has("__row")


def links_by_fingerprint(rows: DataFrame) -> DataFrame:
    """Links (a, b) that connect the nodes of ``rows`` (__row, node, text) whose texts ``simhash_groups`` puts into one group."""
    groups = simhash_groups(rows.select(F.col("__row").alias("doc_id"), "text"))
    groups = groups.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("alike"))
    named = materialize(rows.select("__row", "node").join(groups, "__row").select("alike", "node").distinct(), "alike")
    lowest = named.groupBy("alike").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    lowest = materialize(lowest.where("low < high").select("alike", "low"), "lowest")
    return named.join(lowest, "alike").where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b"))


def drop_near_texts(docs: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """One row of each group of near duplicates of ``docs`` (doc_id, text and others), with its columns.

    Texts are linked if their sets of five-word shingles, lower-cased, have a Jaccard similarity of
    ``threshold`` or more; a group is all that links connect. Texts without words are one group. The row
    with the smallest doc_id stays (null only if all are), of several the one with the smallest hash of its
    text: rows are told apart by a key of their own, so rows that share a doc_id, or have none, go only as
    near duplicates of a row that stays.

    Candidates have fingerprints at most two bits apart (``simhash.simhash_groups``, compared bit-sliced), or share a band of
    MinHash values, since fingerprints alone would miss links near the threshold. Both connect them into components, and
    within these all texts are compared exactly. Shingles are compared by 64-bit hashes. Texts with equal sets are one
    node, so copies are not compared. Sets are made anew for the candidates only. Bloom filters tell which keys
    and texts a join may concern; all others are not shuffled, whatever the size of the other side.
    """
    columns = tuple(docs.columns)
    rows = signatures(docs, columns).withColumns({"__row": F.monotonically_increasing_id(), "__hash": F.xxhash64("text")})
    rows = materialize(rows, "signatures")
    nodes = materialize(rows.select("node", "keys").dropDuplicates(["node"]), "nodes")
    keys = nodes.select("node", F.explode("keys").alias("key"))
    starts = keys.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    starts = materialize(starts.where("low < high").select("key", "low"), "bands")
    shared = keys_in(nodes, bloom_of(starts, ["key"], FILTER_BITS))
    candidates = shared.join(starts, "key").where("node > low").select(F.col("node").alias("a"), F.col("low").alias("b"))
    candidates = candidates.unionByName(links_by_fingerprint(rows)).distinct()
    labels = connected_components(materialize(candidates, "candidates"), [])
    labels = materialize(labels, "labels")

    one = materialize(rows.join(labels, "node").groupBy("node", "component").agg(F.min("__row").alias("__row")), "sampled")
    texts = rows.select("__row", "text").where(row_in(bloom_of(one, ["__row"], FILTER_BITS))).join(one, "__row")
    # Stored between two steps in Python: in one stage each task would take two workers.
    texts = materialize(texts, "texts")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            hashes, at = shingle_sets(block.column("__text"))
            lists = list_array(hashes.view(np.int64), np.diff(at), pa.int64())
            yield pa.RecordBatch.from_arrays([block.column("component"), block.column("node"), lists], ["component", "node", "hashes"])

    compared = texts.select("component", "node", "text").mapInArrow(sets, "component long, node long, hashes array<long>")
    links = materialize(verified_links(materialize(compared, "sets"), threshold, tile), "near")
    groups = materialize(connected_components(links, []).select("node", F.col("component").alias("group")), "groups")

    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__hash", "__row")
    lowest = rows.groupBy("node").agg(F.min(order).alias("first"))
    lowest = lowest.join(groups, "node", "left").groupBy(F.coalesce("group", "node")).agg(F.min("first").alias("first"))
    kept = materialize(lowest.select(F.col("first.__row").alias("__row")), "kept")
    gone = materialize(rows.select("__row").join(kept, "__row", "left_anti"), "gone")
    doubtful = row_in(bloom_of(gone, ["__row"], FILTER_BITS))
    judged = rows.where(doubtful).join(gone, "__row", "left_anti")
    return rows.where(~doubtful).unionByName(judged).select(*columns)
