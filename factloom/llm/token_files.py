"""Token ids as Parquet list columns that can be read selectively."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.blocks import coded, list_array, ragged_take, split_lists, text_blocks
from factloom.session import materialize

#: A space before another blank, or at the end: here a space does not begin a token of its own word.
ODD_SPACE = (
    r" [\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]| $"
)
#: Further places where a token always begins: a mark after a letter, and on both sides of a single line break.
MARK_AFTER_LETTER = r"(\p{L})([.,;:!?])"
BREAK = r"([^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{3000}])\n([^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{3000}])"
CUT = "\x01"
KNOWN_LIMIT = 200_000
BLOCK = 3_000_000
TOGETHER = 50

#: Ids draw on a vocabulary: dictionary encoding, 2 bytes each. Ids of documents and places rise: delta
#: encoding, which the second version of the page format uses for numbers without a dictionary.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "500",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#first": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


class WordEncoder:
    """A byte-level tokenizer of the tokenizers library that encodes each distinct word of a block once.

    Its pattern starts a new token at every single space between two non-blanks, and at marks after
    letters, so a text may be cut there. Texts with other blanks around a space, or with one of the
    tokenizer's added tokens (``<|endoftext|>``), are encoded whole, as the library does it.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        # In a byte-level vocabulary each character of a token stands for one byte.
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        # Words met before: the place of each, and its run of ids in one array.
        self.known: dict[str, int] = {}
        self.table, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32) for e in found]

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words with a leading space, one after the other, and how many each has: several words go in one
        call and are cut apart by their bytes."""
        texts = words.to_pylist()
        found = self._encode(["".join(texts[i : i + TOGETHER]) for i in range(0, len(texts), TOGETHER)])
        ids = np.concatenate(found) if found else np.zeros(0, np.int32)
        ends = np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64))
        return ids, np.diff(np.searchsorted(np.cumsum(self.width[ids]), ends, side="left") + 1, prepend=0)

    def _runs(self, distinct: pa.Array, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(table, starts, sizes): the ids of word i are the run of sizes[i] from starts[i] of the table."""
        words = distinct.to_pylist()
        at = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        old, new = at >= 0, np.flatnonzero(at < 0)
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        starts[old], sizes[old] = self.starts[at[old]], self.sizes[at[old]]
        spaced = pc.starts_with(distinct.take(pa.array(new)), " ").to_numpy(zero_copy_only=False)
        bare = self._encode([words[i] for i in new[~spaced]])
        ids, lengths = self._encode_words(distinct.take(pa.array(new[spaced])))
        new = np.concatenate([new[spaced], new[~spaced]])
        sizes[new] = np.concatenate([lengths, np.array([len(b) for b in bare], np.int64)])
        table = np.concatenate([self.table, ids, *bare])
        starts[new] = len(self.table) + np.cumsum(sizes[new]) - sizes[new]
        kept = new[seen[new] > 1][: max(0, KNOWN_LIMIT - len(self.known))]
        self.known.update(zip([words[i] for i in kept], range(len(self.known), len(self.known) + len(kept)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.table) + np.cumsum(sizes[kept]) - sizes[kept]])
        self.sizes = np.concatenate([self.sizes, sizes[kept]])
        self.table = np.concatenate([self.table, ragged_take(table, starts, sizes, kept)])
        return table, starts, sizes

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and how many each has."""
        whole = pc.match_substring_regex(texts, f"{ODD_SPACE}|{CUT}")
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        odd = whole.to_numpy(zero_copy_only=False)
        whole = self._encode(texts.filter(pa.array(odd)).to_pylist())
        cut = pc.replace_substring(pc.if_else(pa.array(odd), "", texts), " ", f"{CUT} ")
        cut = pc.replace_substring_regex(cut, MARK_AFTER_LETTER, rf"\1{CUT}\2")
        cut = pc.replace_substring_regex(cut, BREAK, rf"\1{CUT}\n{CUT}\2".replace(r"\n", "\n"))
        flat, row = split_lists(pc.split_pattern(cut, CUT))
        codes, distinct = coded(flat)
        table, starts, sizes = self._runs(distinct, np.bincount(codes, minlength=len(distinct)))
        plain = ~odd[row]
        picks, row = codes[plain], row[plain]
        if whole:
            # Texts encoded whole are runs of their own, after those of the words.
            lengths = np.array([len(ids) for ids in whole], np.int64)
            starts = np.concatenate([starts, len(table) + np.cumsum(lengths) - lengths])
            sizes, table = np.concatenate([sizes, lengths]), np.concatenate([table, *whole])
            picks = np.concatenate([picks, len(distinct) + np.arange(len(whole))])
            row = np.concatenate([row, np.flatnonzero(odd)])
            order = np.argsort(row, kind="stable")
            picks, row = picks[order], row[order]
        counts = np.bincount(row, weights=sizes[picks], minlength=len(texts)).astype(np.int64)
        return ragged_take(table, starts, sizes, picks), counts


@lru_cache(maxsize=2)
def load_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 0) -> None:
    """Encode ``docs`` (doc_id, text) and write files in ascending doc_id order to the folder ``out``.

    Each row holds part (rank of its file), doc_id, first (number of ids before it in the file), n_tokens
    and ids (list of int, ``end_id`` last). A null or empty text has the end id alone; nulls of doc_id
    come first; rows that repeat a doc_id stand next to each other, ordered by text. Other columns are
    ignored.

    Texts are range partitioned by doc_id once, encoded where they arrive, and written by Spark's
    committer, so a lost executor's files are written again. Row groups are small enough to be read
    alone; pages have a column index and an offset index, so a filter on doc_id reads its pages only.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer_path)
        before = 0
        for block in text_blocks(batches, limit=BLOCK):
            ids, sizes = encoder.encode_block(block.column("__text"))
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id)
            sizes = sizes + 1
            first = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [block.column("part"), block.column("doc_id"), pa.array(first), pa.array(sizes), list_array(ids, sizes, pa.int32())],
                ["part", "doc_id", "first", "n_tokens", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered = ordered.withColumn("part", F.spark_partition_id())
    rows = ordered.mapInArrow(run, f"part int, doc_id {kind}, first long, n_tokens long, ids array<int>")
    rows.write.options(**LAYOUT).parquet(out)


def read_token_files(spark: SparkSession, path: str, columns: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ``columns``. Only these columns are read; a filter
    on doc_id is pushed down to row groups and pages."""
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One small row per file, stored so that its size is known: then the ids need not be shuffled to meet it.
    starts = materialize(totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "starts")
    return files.join(starts, "part").select("doc_id", (F.col("first") + F.col("offset")).alias("start"), *columns)


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (ids as little-endian unsigned 32-bit integers) of rows read back."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy().astype("<u4"))).cast("B")
            at = lists.offsets.to_numpy().astype(np.int64) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            arrays = [batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
