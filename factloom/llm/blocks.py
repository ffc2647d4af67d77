"""Arrow helpers for functions that run inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 4_000_000


def give_back() -> None:
    """Return freed memory to the system: workers live on, and what one step took would add to the next.

    numpy and the tokenizers take theirs from the C library, which keeps it; other libraries than glibc have no such call."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``limit`` bytes of text, so that memory does not depend on
    how many rows a batch has. A longer text makes a slice of its own. Adds ``__text``, with empty
    texts for nulls. At the end freed memory is given back."""
    for batch in batches:
        texts = pc.fill_null(batch.column(column), "")
        batch = batch.append_column("__text", texts)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes // 2) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
            if end > start:
                yield batch.slice(start, end - start)
    give_back()


def carried(docs, columns: tuple[str, ...]) -> str:
    """Schema of columns that a function passes on."""
    return ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)


def split_lists(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The values of a list array and the row that each came from."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten(), np.repeat(np.arange(len(lengths)), lengths)


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts, one after the other, and the row of each."""
    flat, row = split_lists(pc.ascii_split_whitespace(texts))
    full = pc.greater(pc.binary_length(flat), 0)
    return flat.filter(full), row[full.to_numpy(zero_copy_only=False)]


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes and the distinct values."""
    if len(values) == 0:
        return np.zeros(0, np.int64), values
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def distinct_codes(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of codes below ``size``: those that occur, the rank of each code among them, and how often they occur."""
    counts = np.bincount(codes, minlength=size)
    values = np.flatnonzero(counts)
    rank = np.zeros(size, np.int64)
    rank[values] = np.arange(len(values))
    return values, rank[codes], counts[values]


def ragged_take(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Concatenate the runs ``flat[starts[p] : starts[p] + lengths[p]]`` for each ``p`` of ``picks``."""
    size = lengths[picks]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    offset = np.repeat(starts[picks] - (ends - size), size)
    return flat[offset + np.arange(total)]


def joined_runs(parts: list[np.ndarray], picks: np.ndarray, row: np.ndarray, whole: dict[int, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of ``n`` texts one after the other, and how many each has: text ``row[i]`` has the run
    ``parts[picks[i]]``, in this order; those in ``whole`` have one run of their own."""
    if whole:
        picks = np.concatenate([picks, len(parts) + np.arange(len(whole))])
        row = np.concatenate([row, np.array(list(whole), np.int64)])
        order = np.argsort(row, kind="stable")
        picks, row = picks[order], row[order]
    runs = [*parts, *whole.values()]
    sizes = np.array([len(p) for p in runs], np.int64)
    table = np.concatenate(runs) if runs else np.zeros(0, np.int32)
    ids = ragged_take(table, np.cumsum(sizes) - sizes, sizes, picks)
    return ids, np.bincount(row, weights=sizes[picks], minlength=n).astype(np.int64)


def list_array(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of rows sorted by ``keys``, cut anew so that no group spans two, and the bounds of the groups.

    The caller bounds the size of a group before it deals out the rows.
    """
    rest = None
    for batch in batches:
        if rest is not None and len(rest):
            batch = pa.concat_batches([rest, batch])
        if not len(batch):
            continue
        change = np.zeros(len(batch), bool)
        for key in keys:
            column = batch.column(key).to_numpy(zero_copy_only=False)
            change[1:] |= column[1:] != column[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(change)])
        if bounds[-1]:
            yield batch.slice(0, bounds[-1]), bounds
        rest = batch.slice(bounds[-1])
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def list_parts(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list array, and where each list begins and ends in them."""
    lengths = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
