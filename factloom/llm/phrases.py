"""Phrase collocations by Toivonen's method: a sample proposes, full passes count and close the border."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil, floor, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.blocks import coded, list_array, list_parts, text_blocks
from factloom.operators.ranking import top_k
from factloom.session import materialize, scratch_path

#: Language of a document without one.
NO_LANG = "und"
#: Text, and words, that are worked on at once.
BLOCK_BYTES, BLOCK_WORDS, ROW_WORDS = 3_000_000, 1 << 18, 100
DICTIONARY_BYTES = 16 << 20
#: Stands between pieces in place of a word.
END = 0
#: Bits of a filter for each phrase, and at most: 64 MB. A fuller filter admits more phrases than it should, which
#: costs time and changes no result.
BITS_EACH, MOST_BITS = 16, 1 << 29

_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = _BLANK
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def piece_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The lower-cased words of all texts one after the other, the row of each, and a number of its piece."""
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    kind = _KIND[data]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][at[:-1] < len(data)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    row = np.searchsorted(at[1:], starts, side="right")
    piece = np.cumsum(kind == _BREAK)[starts] + row
    before = np.cumsum(inside)[starts] - 1
    letters = _LOWER[data[inside]]
    offsets = np.append(before, len(letters)).astype(np.int64)
    flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return flat, row, piece


def _longer_hash(start: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase out of the hashes of all words but the last, and of the last."""
    h = (start ^ (start >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@dataclass
class Members:
    """A set of phrases, by their hashes, as bits of fixed number; it may admit others, never refuses its own."""

    bits: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mask = np.uint64(len(self.bits) * 64 - 1)

        def bit(h: np.ndarray) -> np.ndarray:
            h = h & mask
            return (self.bits[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1)

        return (bit(hashes) & bit(hashes >> np.uint64(32))).astype(bool)


def _columns(longest: int) -> list[str]:
    return [f"w{i}" for i in range(1, longest + 1)]


def _phrase_hashes(batch: pa.RecordBatch, size: int) -> np.ndarray:
    words = [batch.column(c).to_numpy().view(np.uint64) for c in _columns(size)]
    return reduce(_longer_hash, words)


def phrase_members(phrases: DataFrame, size: int) -> Members:
    """Filter over ``phrases`` of ``size`` words (w1, w2, …), as bits that an aggregate puts together."""
    bits = 1 << ceil(log2(max(1024, min(MOST_BITS, BITS_EACH * phrases.count()))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _phrase_hashes(batch, size)
            places = np.concatenate([hashes, hashes >> np.uint64(32)]) & np.uint64(bits - 1)
            slots, at = np.unique(places >> np.uint64(6), return_inverse=True)
            words = np.zeros(len(slots), np.uint64)
            np.bitwise_or.at(words, at, np.uint64(1) << (places & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(words.view(np.int64))], ["slot", "bits"])

    found = phrases.select(*_columns(size)).mapInArrow(run, "slot long, bits long")
    found = found.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Members(out)


def _refused(phrases: DataFrame, members: Members, size: int) -> bool:
    """Whether a filter lacks one of the phrases."""
    shared = phrases.sparkSession.sparkContext.broadcast(members)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~shared.value.has(_phrase_hashes(batch, size)))).select(["w1"])

    return bool(phrases.select(*_columns(size)).mapInArrow(run, "w1 long").take(1))


def word_hash(salt: int) -> Column:
    """The hash of a word (lang, word), as ``tokenized`` computes it."""
    hashed = F.xxhash64(F.concat_ws(" ", F.lit(str(salt)), "lang", "word"))
    return F.when(hashed == END, F.lit(1).cast("long")).otherwise(hashed)


def tokenized(docs: DataFrame, salt: int) -> DataFrame:
    """Texts read once, as two kinds of rows: (lang, word, n), the words of a block of texts, and tokens, the
    hashes of words in order with END after each piece. A hash stands for a word in a language. Rows of tokens hold whole
    pieces and about ROW_WORDS words, whatever the length of a text, so that what is read again comes in small batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = ["lang", "word", "n", "tokens"]
        for block in text_blocks(batches, limit=BLOCK_BYTES):
            flat, row, piece = piece_words(block.column("__text"))
            if not len(flat):
                continue
            langs, lang_names = coded(block.column("lang").cast(pa.string()))
            codes, distinct = coded(flat)
            own, kinds = pd.factorize(langs[row] * len(distinct) + codes)
            lang = lang_names.take(pa.array(kinds // len(distinct)))
            word = distinct.take(pa.array(kinds % len(distinct))).cast(pa.string())
            digest = xxhash.xxh64_intdigest
            pairs = zip(lang.to_pylist(), word.to_pylist(), strict=True)
            hashes = np.array([digest(f"{salt} {a} {w}", 42) for a, w in pairs], np.uint64).view(np.int64)
            hashes[hashes == END] = 1
            n, none = np.bincount(own, minlength=len(kinds)).astype(np.int64), len(kinds)
            yield pa.RecordBatch.from_arrays([lang, word, pa.array(n), pa.nulls(none, pa.list_(pa.int64()))], names)
            last = np.append(piece[1:] != piece[:-1], True)
            at = np.flatnonzero(last) + 1
            tokens = np.insert(hashes[own], at, END)
            ends = np.flatnonzero(tokens == END) + 1
            cuts = ends[np.append(ends[1:] // ROW_WORDS != ends[:-1] // ROW_WORDS, True)]
            lists = list_array(tokens, np.diff(cuts, prepend=0), pa.int64())
            empty = [pa.nulls(len(lists), kind) for kind in (pa.string(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, lists], names)

    return docs.mapInArrow(run, "lang string, word string, n long, tokens array<long>")


def _admitted(hashes: np.ndarray, levels: list[Members], longest: int) -> list[np.ndarray]:
    """For 2 to ``longest`` words: where phrases start both of whose shorter parts ``levels`` has."""
    out, here, known = [], hashes, hashes != END
    for size in range(2, min(longest, len(levels) + 1) + 1):
        fine = known & levels[size - 2].has(here)
        within = np.zeros(len(hashes), bool)
        within[:-1] = fine[:-1] & fine[1:]
        out.append(within)
        last = np.zeros_like(hashes)
        last[: 1 - size] = hashes[size - 1 :]
        here, known = _longer_hash(here, last), within
    return out


def block_counts(tokens: np.ndarray, passes: list[list[Members]], longest: int) -> Iterator[pa.RecordBatch]:
    """(size, w1, w2, …, n): phrases that the last of ``passes`` admits and no earlier one did."""
    names = ["size", *_columns(longest), "n"]
    hashes = tokens.view(np.uint64)
    new = _admitted(hashes, passes[-1], longest)
    for earlier in passes[:-1]:
        for mask, seen in zip(new, _admitted(hashes, earlier, longest), strict=False):
            mask &= ~seen
    own, kinds = pd.factorize(tokens)
    for size, mask in enumerate(new, start=2):
        at = np.flatnonzero(mask)
        if not len(at):
            continue
        key = own[at]
        for k in range(1, size):
            # Renumbered before each further word, so that keys stay small and exact.
            key = key * len(kinds) + own[at + k]
            key, distinct = pd.factorize(key)
        example = np.zeros(len(distinct), np.int64)
        example[key] = at
        words = [tokens[example + k] if k < size else np.zeros(len(example), np.int64) for k in range(longest)]
        count = np.bincount(key, minlength=len(distinct)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(example), size, np.int32)), *map(pa.array, words), pa.array(count)], names)


def _token_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The tokens of several rows together, about BLOCK_WORDS at a time; each row ends with END."""
    held, size = [], 0
    for batch in batches:
        flat, at = list_parts(batch.column("tokens"))
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(at, at[start] + BLOCK_WORDS - size, side="right")) - 1)
            held.append(flat[at[start] : at[stop]])
            size += len(held[-1])
            start = stop
            if size >= BLOCK_WORDS // 2:
                yield np.concatenate(held)
                held, size = [], 0
    if held:
        yield np.concatenate(held)


def counted(tokens: DataFrame, passes: list[list[Members]], longest: int) -> DataFrame:
    """Counts (size, w1, w2, …, n) over all of ``tokens``."""
    shared = tokens.sparkSession.sparkContext.broadcast(passes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _token_blocks(batches):
            yield from block_counts(block, shared.value, longest)

    words = ", ".join(f"{c} long" for c in _columns(longest))
    rows = tokens.mapInArrow(run, f"size int, {words}, n long")
    return rows.groupBy("size", *_columns(longest)).agg(F.sum("n").alias("n"))


@dataclass
class Phrases:
    """words: (lang, word, hash, n) of all words; frequent: (size, w1, w2, …, n), words by their hash, unused ones END."""

    words: DataFrame
    frequent: DataFrame


def _stored(rows: DataFrame) -> DataFrame:
    """Written and read again, compressed more than usual and with dictionaries large enough for the words of a file."""
    path = scratch_path(rows.sparkSession, "tokens")
    rows.write.options(**{"compression": "zstd", "parquet.dictionary.page.size": DICTIONARY_BYTES}).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def word_tables(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(words, tokens). Two words of one hash, of which one is frequent, would be counted as one: then another salt is taken."""
    salt = 0
    while True:
        stored = _stored(tokenized(docs, salt))
        words = stored.where("tokens is null").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        words = materialize(words.withColumn("hash", word_hash(salt)), "words")
        shared = words.groupBy("hash").agg(F.count("*").alias("kinds"), F.max("n").alias("n"))
        if not shared.where((F.col("kinds") > 1) & (F.col("n") >= least)).take(1):
            return words, stored.where("tokens is not null").select("tokens")
        salt += 1


def _release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of steps whose results are stored by now. Its cleaner follows the garbage
    collection of the driver, which a small driver heap of a long job may not need for hours."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def frequent_phrases(docs: DataFrame, least: int, longest: int, rate: float, seed: int = 0) -> Phrases:
    """All phrases of up to ``longest`` words found ``least`` times in their language.

    Words are counted over all documents first. Then a sample of ``rate`` of the texts, drawn by runs of pieces, proposes longer
    phrases that reach a lowered count there. The first full pass counts the proposals and their negative border: each phrase whose two
    parts, without its last or its first word, are frequent words or were proposed. That is tested on filters of
    bounded size, so the border is never listed. Where a phrase of the border proves frequent, longer ones with it were
    not counted: then a further pass counts those, and only those, that its filters admit and the earlier ones did
    not. The border is closed when no frequent phrase is missing in the last filters. Each phrase is counted
    in exactly one pass, over all documents, so all counts are exact whatever the sample was."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), "text")
    words, tokens = word_tables(docs, least)
    frequent_words = materialize(words.where(F.col("n") >= least).select(F.col("hash").alias("w1"), "n"), "frequent-words")
    _release(docs)
    lowered = max(2, floor(0.8 * rate * least))
    sample = tokens.sample(rate, seed)
    proposed = [phrase_members(frequent_words, 1)]
    for size in range(2, longest):
        found = counted(sample, [proposed], size).where((F.col("size") == size) & (F.col("n") >= lowered))
        proposed.append(phrase_members(materialize(found, "proposed"), size))
        del found
        _release(docs)

    unused = {c: F.lit(END).cast("long") for c in _columns(longest)[1:]}
    tables = [frequent_words.withColumns({"size": F.lit(1), **unused}).select("size", *_columns(longest), "n")]
    passes = [proposed]
    while True:
        found = counted(tokens, passes, longest).where(F.col("n") >= least)
        tables.append(materialize(found, "frequent"))
        del found
        _release(docs)
        frequent = reduce(DataFrame.unionByName, tables)
        shorter = [(frequent.where(F.col("size") == size), size) for size in range(2, longest)]
        if not any(_refused(part, members, size) for (part, size), members in zip(shorter, passes[-1][1:], strict=True)):
            return Phrases(words, frequent)
        passes.append([proposed[0], *(phrase_members(part, size) for part, size in shorter)])


def collocations(
    docs: DataFrame, least: int = 10, longest: int = 3, covered: int = 50, limit: int = 2000, rate: float = 0.25
) -> DataFrame:
    """The strongest phrases of 2 to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    ``docs`` has lang and text. Texts are lower-cased (A-Z) and cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, these into words at
    spaces and tabs; phrases lie within a piece and may overlap. a is the count of a phrase found ``least`` times or more; l and r are
    those of its two parts at the cut with the lowest score, floor(1000000 * a * a / (l * r)), the earliest of several;
    n counts all words of the language. Phrases within a longer frequent one that has ``covered`` percent of their count are
    left out. Ranked by score, count and phrase; ``limit`` is the length of the report.

    A null lang is ``und``; a null or empty text has no words, and neither has one of separators only. Every row counts, also
    if it repeats another. An empty table gives an empty result. Other columns are ignored. See ``frequent_phrases`` for the method.
    """
    mined = frequent_phrases(docs, least, longest, rate)
    columns = _columns(longest)
    known = mined.frequent.withColumnRenamed("n", "a")
    candidates = known.where("size >= 2")

    def part(start: Column, length: Column) -> list[Column]:
        """The words of a part, filled up with END."""
        listed = F.concat(F.slice(F.array(*columns), start, length), F.array_repeat(F.lit(END).cast("long"), F.lit(longest) - length))
        return [listed.alias("part")]

    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    for name, start, length in ("l", F.lit(1), F.col("k")), ("r", F.col("k") + 1, F.col("size") - F.col("k")):
        keyed = cuts.select("*", *part(start, length))
        keyed = keyed.withColumns({f"p{i}": F.get("part", F.lit(i)) for i in range(longest)}).drop("part")
        counts = known.select(*[F.col(c).alias(f"p{i}") for i, c in enumerate(columns)], F.col("a").alias(name))
        cuts = keyed.join(counts, [f"p{i}" for i in range(longest)]).drop(*[f"p{i}" for i in range(longest)])
    exact = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    cuts = cuts.withColumns({"over": exact["a"] * exact["a"] * F.lit(1000000).cast("decimal(7,0)"), "under": exact["l"] * exact["r"]})
    lowest = F.min(F.struct(F.expr("over div under").alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("size", *columns, "a").agg(lowest).select("size", *columns, "a", "cut.l", "cut.r", "cut.score")

    lengths = F.sequence(F.lit(2), F.col("size") - 1)
    inner = F.flatten(F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: part(i, m)[0])))
    longer = candidates.where("size >= 3").select(F.explode(inner).alias("part"), "a")
    longer = longer.select(*[F.get("part", F.lit(i)).alias(c) for i, c in enumerate(columns)], "a").groupBy(*columns).agg(F.max("a").alias("most"))
    free = scored.join(longer, columns, "left").where(F.coalesce(F.col("most"), F.lit(0)) * 100 < F.col("a") * covered)

    names = materialize(mined.words.where(F.col("n") >= least).select("hash", "word", F.col("lang").alias("of")), "names")
    for c in columns:
        named = names.select(F.col("hash").alias(c), F.col("word").alias(f"{c}_word"), *(["of"] if c == "w1" else []))
        free = free.join(named, c, "left")  # END has no word
    phrase = F.concat_ws(" ", *[f"{c}_word" for c in columns])
    named = free.select(F.col("of").alias("lang"), phrase.alias("phrase"), "a", "l", "r", "score")
    totals = mined.words.groupBy("lang").agg(F.sum("n").alias("n"))
    named = named.join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return top_k(named, ["lang"], order, limit).withColumn("rank", F.col("rank").cast("long"))
