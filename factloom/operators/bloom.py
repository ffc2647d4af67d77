"""Bloom filters: a set of hashes as bits of bounded number, built by an aggregate and broadcast once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each member, and at most (64 MB). A fuller filter lets more through that is not in the set, never less.
BITS_EACH, MOST_BITS = 16, 1 << 29


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One well scattered 64-bit hash of aligned 64-bit values."""
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            out = (out ^ part.view(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
            out = (out ^ (out >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
            out = out ^ (out >> np.uint64(29))
    return out


@dataclass(frozen=True)
class Bloom:
    bits: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.bits) * 64 - 1)

        def bit(h: np.ndarray) -> np.ndarray:
            h = h & mask
            return (self.bits[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1)

        return (bit(hashes) & bit(hashes >> np.uint64(32))).astype(bool)


def bloom_of(members: DataFrame, columns: list[str], most_bits: int = MOST_BITS) -> Bloom:
    """Filter over ``members``, whose ``columns`` (longs) are mixed into one hash. Store ``members`` before: it is read twice.

    What comes to the driver is at most ``most_bits`` bits, however many members there are."""
    size = 1 << ceil(log2(max(1024, min(most_bits, BITS_EACH * members.count()))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = mixed(*[batch.column(c).to_numpy() for c in columns])
            places = np.concatenate([hashes, hashes >> np.uint64(32)]) & np.uint64(size - 1)
            slots, at = np.unique(places >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(slots), np.uint64)
            np.bitwise_or.at(bits, at, np.uint64(1) << (places & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(bits.view(np.int64))], ["slot", "bits"])

    longs = members.select(*[F.col(c).cast("long").alias(c) for c in columns])
    found = longs.mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Bloom(out)
